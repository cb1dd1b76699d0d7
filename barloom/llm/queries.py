"""Registered queries of the operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, collision_neardup, decontaminate, html_extract, line_dedup, lsa_quality, order_minhash, quality_rules, sharding, suffix_dedup, token_align, url_rules, whitening
from barloom.llm.common import LOWER, UPPER, table

#: The white space of the contracts, in DuckDB.
WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("line_total").alias("n_lines"), F.col("line_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, {WHITE_SQL}), '{UPPER}', '{LOWER}') AS key FROM lines
), hot AS (
    SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE max_doc IS NOT NULL AND doc_id <> max_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE max_doc IS NULL OR doc_id = max_doc), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (key) GROUP BY doc_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op3_sql() -> str:
    """The statistics set-wise, then every round of EM as a CTE of its own."""
    rules = quality_rules.RULES
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END AS {v}" for v, (good, bad) in rules.items())
    names = ", ".join(rules)
    odds = " + ".join(["ln(prior / (1 - prior))", *(f"CASE {v} WHEN 1 THEN ln({v}_g / (1 - {v}_b)) WHEN 0 THEN ln((1 - {v}_g) / {v}_b) ELSE 0 END" for v in rules)])
    start = ", ".join(f"{quality_rules.START_RIGHT}::DOUBLE AS {v}_g, {quality_rules.START_RIGHT}::DOUBLE AS {v}_b" for v in rules)
    clamp = "least(greatest(({} + 1) / ({} + 2), 0.5), 0.999)"
    step = ", ".join(
        clamp.format(f"coalesce(sum(n * p) FILTER (WHERE {v} = 1), 0)", f"coalesce(sum(n * p) FILTER (WHERE {v} IS NOT NULL), 0)") + f" AS {v}_g, "
        + clamp.format(f"coalesce(sum(n * (1 - p)) FILTER (WHERE {v} = 0), 0)", f"coalesce(sum(n * (1 - p)) FILTER (WHERE {v} IS NOT NULL), 0)") + f" AS {v}_b" for v in rules)
    rounds = [f"""m{k} AS MATERIALIZED (
        SELECT (sum(n * p) + 1) / (sum(n) + 2) AS prior, {step} FROM (SELECT patterns.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns, m{k - 1}))""" for k in range(1, quality_rules.ROUNDS + 1)]
    words = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
    return f"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS t, {words} AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {WHITE_SQL}) <> '') AS lines FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM split WHERE len(words) >= 5
), grams AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS g FROM windows
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), covered AS (
    SELECT doc_id, sum(least(5, i - coalesce(lag, i - 5))) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS lag FROM repeated) GROUP BY doc_id
), stats AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
           length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_capitals, length(t) - length(replace(t, '!', '')) AS n_exclaims, len(list_distinct(words)) AS n_distinct_words
    FROM split LEFT JOIN covered USING (doc_id)
), votes AS MATERIALIZED (
    SELECT *, ({quality_rules.BASE_FAILED}) AS base_failed, {votes} FROM stats
), patterns AS MATERIALIZED (
    SELECT {names}, count(*)::DOUBLE AS n FROM votes WHERE NOT base_failed GROUP BY ALL
), m0 AS (SELECT {quality_rules.START_PRIOR}::DOUBLE AS prior, {start}),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds}))) >= {quality_rules.CUT} AS kept
FROM votes, m{quality_rules.ROUNDS}
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANK_FILE, public_tokenizers.PATTERN, checked=True)
    return both.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "decoded_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))["n"]
    return found.select("doc_id", F.col("word_count").alias("n_words"), hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP5_SQL = f"""
WITH d AS (
    SELECT doc_id, {_WORDS_SQL} AS w FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, item, n, i FROM places JOIN windows USING (n, g)
), covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, unnest(range(0, n)) AS k FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = lsa_quality.scored(docs, lsa_quality.fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", lsa_quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= lsa_quality.CUT).cast("int").alias("predicted"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def _op7_sql() -> str:
    """Frequent token sets as all subsets of each URL's tokens, by bit masks."""
    fits = lambda rule: (lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))")(*rule.split("/", 1))
    rules = sorted(url_rules.FIXED_RULES, key=lambda r: -len(r[0]))
    case = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in rules) + " END"
    return f"""
WITH parts AS (
    SELECT page_id, coalesce(url, '') AS url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), tokens AS (
    SELECT page_id, host, path, {case} AS rule, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_concat(
        ['scheme:' || translate(string_split(url, '://')[1], '{UPPER}', '{LOWER}')],
        list_transform(string_split(host, '.'), lambda x, i: 'host' || (len(string_split(host, '.')) - i + 1)::VARCHAR || ':' || x),
        list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'path:' || x),
        list_transform(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'field:' || string_split(x, '=')[1])))) END AS t
    FROM parts
), masks AS (
    SELECT page_id, path, t, unnest(range(1, 1 << len(t))) AS m FROM tokens WHERE len(t) > 0
), subsets AS (
    SELECT page_id, path, array_to_string(list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1), chr(10)) AS s FROM masks
), bad AS (
    SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id HAVING bool_or(quality = 0 OR toxic = 1) IS NOT NULL
), named AS (
    SELECT page_id, bad FROM tokens JOIN bad ON doc_id = try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) WHERE len(t) > 0
), mined AS (
    SELECT s FROM subsets JOIN named USING (page_id) GROUP BY s
    HAVING count(*) FILTER (WHERE bad) >= ceil(greatest({url_rules.MIN_SUPPORT}, least(1, {url_rules.MIN_URLS} / (SELECT count(*) FROM named))) * (SELECT count(*) FROM named))
       AND count(*) FILTER (WHERE bad) / count(*) >= {url_rules.MIN_CONFIDENCE}
), blocked AS (SELECT DISTINCT page_id FROM subsets JOIN mined USING (s))
SELECT page_id, host, path, rule, coalesce({verdict}, CASE WHEN blocked.page_id IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM tokens LEFT JOIN blocked USING (page_id)
"""


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_align.alignment_statistics(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it exceeds a long, which takes some 10 million distinct vectors of this kind."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")


def op13_collision_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_neardup.near_vectors(table(spark, sf_dir, "embeddings"))


_ALL = (op1_line_dedup, op2_html_extraction, op3_quality_rules, op4_byte_bpe, op5_decontamination, op6_quality_classifier, op7_url_filters, op8_suffix_dedup, op9_sharding, op10_order_minhash,
        op11_token_alignment, op12_embedding_whitening, op13_collision_neardup)
QUERIES = {f.__name__: f for f in _ALL}
STATEMENTS = {"op1_line_dedup": OP1_SQL, "op3_quality_rules": _op3_sql(), "op5_decontamination": OP5_SQL, "op7_url_filters": _op7_sql()}
