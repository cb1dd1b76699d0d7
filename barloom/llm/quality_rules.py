"""Quality rules under weak supervision: rules vote or abstain, EM estimates how often each is right, a posterior decides.

No rule must pass. Each votes good (1), bad (0) or abstains (null) from statistics of the whole text. Texts are then counts
of vote patterns, at most 3 ** rules rows whatever the corpus' size, and every round of expectation-maximisation is one
aggregate over that table: the expectation is a SQL expression with the current parameters as literals, the maximisation
sums. A rule's parameters are its chances to vote right on good and on bad texts; abstaining says nothing.

Defined results: a null text has no words and fails the base rule (as does any text under ``MIN_WORDS`` words). Every row is
judged by itself, so repeated rows and ids get repeated results. Without any row that passes the base rule the priors stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WHITE, bind, stored

GAP = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "[#*$%&|<>]+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
ROUNDS = 20
START_RIGHT, START_PRIOR = 0.8, 0.8
CUT = 0.5

#: vote -> (good if, bad if) over the statistics of ``text_statistics``.
RULES = {
    "v_symbols": ("n_symbols * 50 <= n_words", "n_symbols * 10 > n_words"),
    "v_word_length": ("word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    "v_lines": ("n_dup_lines = 0 AND n_lines > 1", "n_dup_lines * 10 > n_lines * 3"),
    "v_repeats": ("n_repeat_words * 50 <= n_words", "n_repeat_words * 10 > n_words"),
    "v_capitals": ("n_capitals * 5 <= word_chars", "n_capitals * 2 > word_chars"),
    "v_exclaims": ("n_exclaims * 20 <= n_words", "n_exclaims * 4 > n_words"),
    "v_variety": ("n_distinct_words * 3 >= n_words", "n_distinct_words * 6 < n_words"),
}


def repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that are found twice or more in the text.

    Windows are 64-bit hashes of word hashes. Only if some are equal are they sorted with their places, equal neighbours
    kept, and the places they cover counted.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            places = F.array_sort(F.transform(same, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(places, start, step)["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(placed, count))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    return F.when(n < WINDOW, F.lit(0)).otherwise(bind(bind(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of every whole text; texts go no further than this."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(WHITE))
    with_words = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    without = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    arrays = docs.select(
        "doc_id", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1)).alias("words"), with_words.alias("lines"),
        without(SYMBOLS).cast("long").alias("n_symbols"), without("\\p{Lu}+").cast("long").alias("n_capitals"), without("!+").cast("long").alias("n_exclaims"))
    return arrays.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_capitals", "n_exclaims", F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"))


BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def cast_votes(stats: DataFrame) -> DataFrame:
    votes = [f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END AS {name}" for name, (good, bad) in RULES.items()]
    return stats.selectExpr("*", f"{BASE_FAILED} AS base_failed", *votes)


def log_odds(prior: float, right: dict[str, tuple[float, float]]) -> str:
    """SQL of ln P(good | votes) - ln P(bad | votes). ``right``: chance of a right vote on good, on bad texts."""
    terms = [f"CASE {v} WHEN 1 THEN {math.log(g / (1 - b))!r}D WHEN 0 THEN {math.log((1 - g) / b)!r}D ELSE 0D END" for v, (g, b) in right.items()]
    return " + ".join([f"{math.log(prior / (1 - prior))!r}D", *terms])


def fit(votes: DataFrame, rounds: int = ROUNDS) -> tuple[float, dict[str, tuple[float, float]]]:
    """Prior and accuracies by EM over the table of vote patterns of the rows that pass the base rule."""
    patterns = stored(votes.where("NOT base_failed").groupBy(*RULES).count().coalesce(1), "vote-patterns")
    prior, right = START_PRIOR, {v: (START_RIGHT, START_RIGHT) for v in RULES}
    for _ in range(rounds):
        sums = ["sum(count) AS n", "sum(count * p) AS good"]
        for v in RULES:
            sums += [f"sum(CASE WHEN {v} = 1 THEN count * p ELSE 0D END) AS {v}_g1", f"sum(CASE WHEN {v} IS NOT NULL THEN count * p ELSE 0D END) AS {v}_g"]
            sums += [f"sum(CASE WHEN {v} = 0 THEN count * (1 - p) ELSE 0D END) AS {v}_b0", f"sum(CASE WHEN {v} IS NOT NULL THEN count * (1 - p) ELSE 0D END) AS {v}_b"]
        r = patterns.selectExpr("*", f"1D / (1D + exp(-({log_odds(prior, right)}))) AS p").selectExpr(*sums).first()
        if not r.n:
            break
        # one pseudo-count for and against each, and a rule is never taken to be worse than a coin
        prior = (r.good + 1) / (r.n + 2)
        chance = lambda hit, of: min(max((hit + 1) / (of + 2), 0.5), 0.999)
        right = {v: (chance(r[f"{v}_g1"], r[f"{v}_g"]), chance(r[f"{v}_b0"], r[f"{v}_b"])) for v in RULES}
    return prior, right


def judge(docs: DataFrame, rounds: int = ROUNDS, cut: float = CUT) -> DataFrame:
    """doc_id, the statistics, the votes, base_failed, quality (posterior) and kept."""
    votes = stored(cast_votes(text_statistics(docs.select("doc_id", "text"))), "text-votes")
    prior, right = fit(votes, rounds)
    return (votes.withColumn("quality", F.expr(f"1D / (1D + exp(-({log_odds(prior, right)})))"))
            .withColumn("kept", F.expr(f"NOT base_failed AND quality >= {cut}D")))
