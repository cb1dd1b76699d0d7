"""Default parameters of the research pipeline and of the telemetry monitors."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal the published defaults for results to match.
LOOKBACK_WINDOWS = (1, 3, 5, 10, 20, 50)
MA_WINDOWS = (5, 10, 20, 50, 200)
VOL_WINDOWS = (5, 10, 20, 60)
TRADING_DAYS = 252

POSITIVE_WORDS = (
    "up", "gain", "rise", "surge", "rally", "bullish", "growth", "profit", "beat", "strong", "positive",
)
NEGATIVE_WORDS = (
    "down", "fall", "drop", "decline", "crash", "bearish", "loss", "miss", "weak", "negative", "warn",
)
POSITIVE_WORDS_TRADE = POSITIVE_WORDS + ("buy",)
NEGATIVE_WORDS_TRADE = NEGATIVE_WORDS + ("sell",)

HOSTILE, NEUTRAL, FAVORABLE = 0, 1, 2
STATE_NAMES = {HOSTILE: "HOSTILE", NEUTRAL: "NEUTRAL", FAVORABLE: "FAVORABLE"}


@dataclass(frozen=True)
class Costs:
    """Per-unit-of-turnover trading costs."""

    spread_bps: float = 5.0
    commission: float = 0.001
    slippage_std: float = 0.0  # 0.0005 turns the keyed random slippage on
    delay_prob: float = 0.0  # 0.1 turns the keyed missed-fill draw on
    seed: int = 42

    def fixed_rate(self) -> float:
        return self.spread_bps / 10000.0 + self.commission


@dataclass(frozen=True)
class Research:
    train_days: int = 252
    test_days: int = 21
    min_train_rows: int = 50
    min_confidence: float = 0.6
    initial_capital: float = 100_000.0
    horizon: int = 5
    cost_bps: float = 10.0
    stress_cost_bps: float = 15.0
    adx_threshold: float = 25.0
    vol_quantile: float = 0.75
    liq_quantile: float = 0.85
    rolling_train_rows: int = 500
    rolling_step_rows: int = 60
    seed: int = 42


@dataclass(frozen=True)
class KillSwitchLimits:
    max_daily_loss_pct: float = 3.0
    min_confidence: float = 0.3
    max_api_errors: int = 3
    expected_slippage_bps: float = 5.0
    max_slippage_multiple: float = 3.0

    @property
    def max_slippage_bps(self) -> float:
        return self.expected_slippage_bps * self.max_slippage_multiple


@dataclass(frozen=True)
class RiskLimits:
    max_total_exposure_pct: float = 150.0
    max_single_asset_pct: float = 50.0
    max_correlated_exposure_pct: float = 80.0
    max_drawdown_pct: float = 10.0
    max_assets: int = 4


COSTS = Costs()
RESEARCH = Research()
KILL_SWITCH = KillSwitchLimits()
RISK = RiskLimits()
