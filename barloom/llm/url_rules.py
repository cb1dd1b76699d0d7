"""URL filtering: fixed host and path rules first, then association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens: scheme, labels of the host counted from the right, path segments with numbers replaced, names of
query fields. FP-growth finds sets of tokens that often occur together with the label token; rules to "bad" stay if
their support and confidence are high enough. They match through an inverted index: tokens of a URL join the index and
a rule fits if as many of its tokens were found as it has. URLs are reduced to their distinct token sets first,
so what is joined grows with the variety of URLs and not with their number.

A page's label is that of the document its URL names (the number in its path): bad if its quality is 0 or it is toxic.

Defined results: a null URL or one without ``://`` has an empty host and path and no tokens; no rule fits it and it is
allowed. Repeated rows are judged alike. Without labels nothing is mined and only the fixed rules block.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, partitions, stored

#: (rule, verdict): host, then path from the first slash.
FIXED_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.7
#: Rules need so many labelled URLs, however few there are.
MIN_URLS = 20
BAD, GOOD = "label:bad", "label:good"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=FIXED_RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    labels = F.split(host, "\\.", -1)
    host_tokens = F.transform(labels, lambda x, i: F.concat(F.lit("host"), (F.size(labels) - i).cast("string"), F.lit(":"), x))
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/", -1), lambda x: x != "")
    fields = F.transform(F.filter(F.split(F.regexp_extract(url, "(?s)^[^?#]*\\?([^#]*)", 1), "&", -1), lambda x: x != ""), lambda x: F.concat(F.lit("field:"), F.substring_index(x, "=", 1)))
    scheme = F.concat(F.lit("scheme:"), ascii_lower(F.substring_index(url, "://", 1)))
    every = F.concat(F.array(scheme), host_tokens, F.transform(segments, lambda x: F.concat(F.lit("path:"), x)), fields)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> DataFrame:
    """(rule, tokens, confidence, support) of the rules to "bad". ``labelled``: (tokens, bad).

    A URL of t tokens has at most 2**t subsets and a frequent one is in ``min_support`` of all, so rules number at most
    2**t / min_support however many URLs there are.
    """
    items = labelled.where(F.size("tokens") > 0).select(F.concat(F.col("tokens"), F.array(F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD)))).alias("items"))
    items = stored(items, "url-items")
    n = items.count()
    empty = items.sparkSession.createDataFrame([], "rule long, tokens array<string>, confidence double, support double")
    if not n:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min(1.0, min_urls / n)), minConfidence=min_confidence, numPartitions=partitions(items.sparkSession)).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule"), F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    return stored(rules, "url-rules")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set_id, tokens, confidence): each token set's most confident rule, through the inverted index from token to rules."""
    index = rules.select("rule", F.size("tokens").alias("n"), "confidence", "support", "tokens", F.explode("tokens").alias("token"))
    found = token_sets.select("set_id", F.explode("tokens").alias("token")).join(index, "token")
    whole = found.groupBy("set_id", "rule").agg(F.count("*").alias("hits"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"), F.first("support").alias("support")).where("hits = n")
    best = F.max_by(F.struct("tokens", "confidence"), F.struct("confidence", "support", "rule")).alias("best")
    return whole.groupBy("set_id").agg(best).select("set_id", F.col("best.tokens").alias("mined_tokens"), F.col("best.confidence").alias("mined_confidence"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined_tokens and mined_confidence (the mined rule that fits, if any)."""
    url = F.col("url")
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("tokens", tokens_of(url, F.col("host"), F.col("path"))).withColumn("set_id", F.md5(F.array_join("tokens", "\n").cast("binary")))
    parts = stored(parts, "url-parts")
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where(F.col("bad").isNotNull())
    named = parts.select("tokens", F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)").alias("doc_id"))
    rules = mine(named.join(bad, "doc_id").select("tokens", "bad"))
    sets = parts.groupBy("set_id").agg(F.first("tokens").alias("tokens"))
    judged = parts.join(matched(sets, rules), "set_id", "left")
    fixed = fixed_rule(F.col("host"), F.col("path"))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in FIXED_RULES], F.when(F.col("mined_confidence").isNotNull(), F.lit("block")), F.lit("allow"))
    return judged.withColumn("rule", fixed).withColumn("verdict", verdict).select("page_id", "url", "host", "path", "rule", "verdict", "mined_tokens", "mined_confidence")
