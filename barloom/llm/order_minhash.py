"""Near-duplicate classes by Order MinHash with banded alignment.

A text is its sequence of word 5-shingles, each labelled with its occurrence number, so that labelled shingles are unique.
Each of a number of sketches takes the labelled shingles of smallest hash and keeps them in text order;
texts with an equal sketch are candidates. A candidate pair is a link if their alignment is long enough: A aligned
shingles of n and m give the similarity A / (n + m - A), and two texts of similarity t can only align places that are
less apart than a band that follows from t, so alignment inside the band is exact for all links.

No group is compared all against all. Equal texts are one node. A candidate that shares too few of its shingles with any other
candidate to reach the similarity is left alone from the start. In each sketch bucket the node that shares most buckets
leads and is compared with the others; classes are the components of the links. Buckets whose nodes are still in several classes
go on with their next leader, until those left have so few pairs that comparing all of them is linear work.
Class labels spread by joins; nothing of it passes through the driver but counts.

Defined results: a null text equals an empty one. Texts under five words form classes only with equal texts. A null id stands
below all ids and classes that hold one have a null class id. Rows that repeat an id keep a row each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

SHINGLE = 5
SIMILARITY = 0.8
#: (sketches, shingles in each, least and most shingles of a text). Long texts: at similarity 0.8 a sketch of eight agrees with a
#: chance of 0.17, so 56 of them miss a link once in 30,000, while texts of similarity 0.4 meet with a chance of 0.04. Short texts
#: have too few shingles for that: two in each of 12. The spans overlap by more than linked texts can differ in length.
SCHEMES = ((12, 2, 1, 64), (56, 8, 48, 1 << 62))
#: Buckets are led, one leader after the other, until the places where classes still meet are at most so many a text; most
#: of them fall to the bound on shared shingles before they become pairs.
PAIRS_PER_TEXT = 32
#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 18
NO_ID = -(1 << 63)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIER = 0x5851F42D4C957F2D
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (len(SCHEMES), max(s[0] for s in SCHEMES)), dtype=np.uint64)
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, max(SHINGLE, *(s[1] for s in SCHEMES)), dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes; arithmetic wraps."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """multiplier ** i and its inverses modulo 2 ** 64, for i under n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 15)
        both = []
        for base in (_MULTIPLIER | 1, pow(_MULTIPLIER | 1, -1, 1 << 64)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of every word: differences of a running polynomial over the bytes, shifted back to the word's start."""
    out = []
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and not _WHITE[raw[end]]:  # a piece ends between words
            end += 1
        data = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _WHITE[data], [True])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            up, down = powers(len(data))
            running = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=running[1:])
            out.append(mix((running[ends] - running[starts]) * down[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def labelled_shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles in text order, each mixed with how often it occurred before."""
    words = word_hashes((text or "").encode())
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    plain = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        plain += words[k:k + n] * _PLACES[k]
    plain = mix(plain)
    order = np.argsort(plain, kind="stable")
    same = np.concatenate(([False], plain[order][1:] == plain[order][:-1]))
    if same.any():
        at = np.arange(n)
        label = np.zeros(n, np.uint64)
        label[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
        plain = mix(plain + label * _ODD)
    return plain


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One key a sketch: its smallest labelled shingles in text order."""
    n = len(shingles)
    keys = [np.zeros(0, np.uint64)]
    for seeds, (sketches, size, least, most) in zip(_SEEDS, SCHEMES):
        if not least <= n <= most:
            continue
        take = min(size, n)
        for at in range(0, sketches, 8):
            own = seeds[at:min(at + 8, sketches), None]
            hashed = mix(shingles[None, :] ^ own)
            chosen = np.argpartition(hashed, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(hashed), 1))
            chosen.sort(axis=1)
            keys.append(mix((shingles[chosen] * _PLACES[:take]).sum(axis=1, dtype=np.uint64) + own[:, 0]))
    return np.concatenate(keys).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """A / (n + m - A) of the longest alignment inside the band that ``least`` allows; 0 where it can't reach ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    needed = least * (n + m) / (1 + least) - 1e-9
    if min(n, m) < needed:
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = max(n, m) - needed
    inside = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[inside], at_b[inside]
    if len(at_a) < needed:
        return 0.0
    # labelled shingles are unique, so the alignment is the longest increasing run of places
    places = at_b[np.argsort(at_a)]
    if (np.diff(places) > 0).all():
        aligned = len(places)
    else:
        tails: list[int] = []
        for p in places.tolist():
            k = bisect_left(tails, p)
            tails[k:k + 1] = [p]
        aligned = len(tails)
    return aligned / (n + m - aligned)


def _node():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _sketch_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, id, node, keys): no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sketch(labelled_shingles(t.as_py())) for t in batch.column(2)]
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "node", "keys"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), _node().alias("node"), "text")
    return rows.mapInArrow(run, "id long, node binary, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity, common) of all pairs; the similarity is 0 if it does not reach ``least``. ``common``: shingles in both, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led, led_shingles = None, None
        for batch in batches:
            out, common = [], []
            for _, b, text_a, text_b in zip(*(batch.column(k) for k in range(4))):
                b = b.as_py()
                if b != led:  # rows come in order of b
                    led, led_shingles = b, labelled_shingles(text_b.as_py())
                own = labelled_shingles(text_a.as_py())
                out.append(similarity(own, led_shingles, least))
                common.append(len(np.intersect1d(own, led_shingles, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array(common, pa.int32())], names=["a", "b", "similarity", "common"])

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a binary, b binary, similarity double, common int")


def _shared_shingles(texts: DataFrame) -> DataFrame:
    """(node, n, s): a text's shingles, and how many of them other candidates have as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [labelled_shingles(t.as_py()) for t in part.column(1)]
                sizes = [len(r) for r in rows]
                nodes = part.column(0).take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(np.concatenate(rows).view(np.int64))], names=["node", "n", "shingle"])

    rows = stored(texts.select("node", "text").mapInArrow(run, "node binary, n int, shingle long"), "near-shingles")
    several = rows.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1").select("shingle")
    return stored(rows.join(several, "shingle").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("s")), "near-shared")


def _possible(least: float, s_a: str, s_b: str, n_a: str, n_b: str):
    """Whether two texts can reach ``least``: they align no more shingles than either shares with anyone."""
    return F.least(s_a, s_b) * (1 + least) + 1e-6 >= (F.col(n_a) + F.col(n_b)) * least


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in links (a, b): the smallest node of each component, by spreading labels and following them."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "near-labels")
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        spread = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(spread.join(ahead, "label", "left").select("node", "old", F.least("label", "next").alias("label")), "near-labels")
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row: the smallest id of its class. ``docs``: doc_id, text."""
    grouped = _groups(docs, least)
    classes = grouped.groupBy("group").agg(F.min("id").alias("class_id"))
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return grouped.join(classes, "group").select(id_of("id").alias("doc_id"), id_of("class_id").alias("class_id"))


def first_of_class(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """All columns of the row of each class that has its smallest id; of rows equal in id and text, any one."""
    firsts = _groups(docs, least).groupBy("group").agg(F.min(F.struct("id", "node")).alias("first")).select(F.col("first.id").alias("__id"), F.col("first.node").alias("__node"))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__node", _node())
    return keyed.join(firsts, ["__id", "__node"]).dropDuplicates(["__id", "__node"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _groups(docs: DataFrame, least: float) -> DataFrame:
    """(id, node, group) of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = stored(_sketch_rows(docs), "near-rows")
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("id", "keys")).alias("first")).select("node", F.col("first.id").alias("rep"), F.col("first.keys").alias("keys")), "near-nodes")
    bands = nodes.select("node", F.explode("keys").alias("key"))
    several = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    active = stored(bands.join(several, "key").select("key", "node"), "near-active")
    candidates = active.select("node").distinct().join(nodes.select("node", "rep"), "node")
    wanted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rep"), _node().alias("node"), "text")
    texts = stored(wanted.join(candidates, ["rep", "node"]).select("node", "text"), "near-texts").dropDuplicates(["node"])
    shared_by = _shared_shingles(texts)
    sized = active.join(shared_by, "node")
    smallest = sized.groupBy("key").agg(F.min("n").alias("low"))
    # a text with too many shingles of its own for the shortest text of a bucket has no link there
    active = stored(sized.join(smallest, "key").where(F.col("s") * (1 + least) + 1e-6 >= (F.col("n") + F.col("low")) * least).select("key", "node", "n", "s", F.lit(None).cast("int").alias("common")), "near-active")
    linear = PAIRS_PER_TEXT * nodes.count()
    seen = spark.createDataFrame([], "a binary, b binary")
    links = spark.createDataFrame([], "a binary, b binary, similarity double, common int")
    labels = spark.createDataFrame([], "node binary, label binary")
    first_round = True
    while True:
        at = active.join(labels, "node", "left").select("key", "node", "n", "s", "common", F.coalesce("label", "node").alias("label"))
        parts = at.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("within"))
        mixed = stored(parts.where("size * size > within"), "near-mixed")
        pairs_left = (mixed.agg(F.sum(F.col("size") * F.col("size") - F.col("within"))).first()[0] or 0) // 2
        at = stored(at.join(mixed.select("key", "size"), "key"), "near-round")
        if not pairs_left:
            break
        last = not first_round and pairs_left <= linear
        if last:
            other = at.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"), F.col("common").alias("common_b"))
            both = F.least("common", "common_b") + F.least(F.col("s") - F.col("common"), F.col("s_b") - F.col("common_b"))
            led_bound = both.isNull() | F.col("common").isNull() | F.col("common_b").isNull() | (both * (1 + least) + 1e-6 >= (F.col("n") + F.col("n_b")) * least)
            apart = (F.col("key") == F.col("key_b")) & (F.col("node") < F.col("b")) & (F.col("label") != F.col("label_b")) & _possible(least, "s", "s_b", "n", "n_b") & led_bound
            pairs = at.join(other, apart).select(F.col("node").alias("a"), "b")
        else:
            shared = at.groupBy("node").agg(F.sum("size").alias("shared"))
            leaders = at.join(shared, "node").groupBy("key").agg(F.max(F.struct("shared", "node", "label", "n", "s")).alias("led")).select("key", F.col("led.node").alias("b"), F.col("led.label").alias("label_b"), F.col("led.n").alias("n_b"), F.col("led.s").alias("s_b"))
            led = stored(at.join(leaders, "key"), "near-led")
            pairs = led.where((F.col("label") != F.col("label_b")) & _possible(least, "s", "s_b", "n", "n_b")).select(F.col("node").alias("a"), "b")
            active = led.where(F.col("node") != F.col("b")).select("key", "node", "n", "s", "common")
        pairs = stored(pairs.distinct().join(seen, ["a", "b"], "left_anti"), "near-pairs")
        compared = stored(_verified(pairs, texts, least), "near-compared")
        if first_round:  # what each text has in common with the first leader of its bucket bounds what two of them have
            with_leader = led.select("key", F.col("node").alias("a"), "b").join(compared.select("a", "b", "common"), ["a", "b"])
            with_leader = with_leader.select("key", F.col("a").alias("node"), "common")
            active = stored(active.drop("common").join(with_leader, ["key", "node"], "left"), "near-active")
        links = stored(links.union(compared.where(F.col("similarity") >= least)), "near-links")
        labels = components(links)
        if last:
            break
        seen = seen.union(pairs)
        first_round = False
    grouped = rows.select("id", "node").join(labels, "node", "left").select("id", "node", F.coalesce("label", "node").alias("group"))
    return stored(grouped, "near-groups")
