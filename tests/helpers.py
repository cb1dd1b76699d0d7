import datetime as dt

import numpy as np
import pandas as pd


def random_bars(symbols=("A", "B"), n=320, seed=42):
    rng = np.random.default_rng(seed)
    frames = []
    for s in symbols:
        close = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
        open_ = close * (1 + rng.normal(0, 0.003, n))
        frames.append(pd.DataFrame({
            "symbol": s, "date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "open": open_,
            "high": np.maximum(open_, close) * 1.004, "low": np.minimum(open_, close) * 0.996, "close": close,
            "volume": rng.integers(1000, 5000, n).astype(float),
        }))
    return pd.concat(frames, ignore_index=True)


def by_key(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
