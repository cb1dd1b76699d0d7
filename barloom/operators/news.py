"""News features aligned to bars and delayed one bar, and the trading targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import NEGATIVE_WORDS, POSITIVE_WORDS
from barloom.functions import rolling as R
from barloom.functions.text import div, keyword_score, safe_div


def headline_sentiment(
    news: DataFrame,
    positive: tuple[str, ...] = POSITIVE_WORDS,
    negative: tuple[str, ...] = NEGATIVE_WORDS,
    out: str = "sentiment",
) -> DataFrame:
    return news.selectExpr("*", f"{keyword_score('headline', positive, negative)} AS {out}")


def daily_news(news: DataFrame) -> DataFrame:
    """Article count and mean keyword sentiment per symbol and calendar day."""
    scored = headline_sentiment(news)
    return scored.groupBy("symbol", F.expr("to_date(ts)").alias("date")).agg(
        F.expr("count(*) AS news_count"), F.expr("avg(sentiment) AS news_sentiment")
    )


def align_news(bars: DataFrame, news: DataFrame) -> DataFrame:
    """Daily news on the bar dates, delayed one bar so that a decision sees only earlier news."""
    joined = bars.join(daily_news(news), ["symbol", "date"], "left")
    delayed = R.over()
    return joined.selectExpr(
        "* EXCEPT (news_count, news_sentiment)",
        f"lag(CAST(coalesce(news_count, 0) AS DOUBLE), 1, 0D) {delayed} AS news_count_aligned",
        f"lag(coalesce(news_sentiment, 0D), 1, 0D) {delayed} AS news_tone_aligned",
    )


def news_features(bars_feat: DataFrame, news: DataFrame) -> DataFrame:
    """Rolling news counts and sentiment and the news/price divergence; needs ``return_1d``.

    Without any news the left join leaves zeros.
    """
    df = align_news(bars_feat, news).selectExpr(
        "*", f"{R.lag('return_1d')} AS _past", f"{R.std('return_1d', 20)} AS _vol"
    )
    cols = [f"news_tone_aligned - {safe_div('_past', '_vol')} AS news_price_divergence"]
    cols += [f"sum(news_count_aligned) {R.frame(n)} AS news_count_{n}d" for n in (1, 3, 7, 14)]
    cols += [f"avg(news_tone_aligned) {R.frame(n)} AS news_sentiment_{n}d" for n in (3, 7, 14)]
    return df.selectExpr("* EXCEPT (news_count_aligned, news_tone_aligned, _past, _vol)", *cols)


def target_open_to_open(df: DataFrame) -> DataFrame:
    """Return of buying the next open and selling the one after."""
    entry, leave = R.lead("open", 1), R.lead("open", 2)
    return df.selectExpr("*", f"{div(f'{leave} - {entry}', entry)} AS next_day_return")


def target_close_to_close(df: DataFrame) -> DataFrame:
    """Older target: next close-to-close return and its sign."""
    out = df.selectExpr("*", f"{div(R.lead('close', 1), 'close')} - 1 AS target_return_1d")
    return out.selectExpr("*", "CAST(signum(target_return_1d) AS INT) AS target_direction")
