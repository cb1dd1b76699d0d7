"""Quality by nearest-neighbour voting between latent-semantic vectors.

Terms are taken from the whole text: pairs of neighbouring byte classes, and the text's shape (how long it is, how often a word
repeats the one before, how varied its words are). A bounded sample of labelled rows gives the inverse document
frequencies, a truncated SVD and the labelled vectors. These three, whose size is fixed by ``SAMPLE``, ``TERMS`` and
``RANK``, are broadcast; every document is then projected and compared with all labelled vectors in blocks, exactly.
The labels of the ``NEIGHBOURS`` nearest, weighted by similarity, are the score.

Defined results: null and empty texts have a shape and so neighbours; their score is theirs. Repeated ids are scored row by
row. A null id is never held out. Without any labelled row to learn from every score is ``NO_LABELS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import give_back

#: At most so many labelled rows are fitted on: those with the smallest hash of their id.
SAMPLE = 4000
RANK = 48
NEIGHBOURS = 15
HELD_OUT_FOLDS = 5
CUT = 0.3
NO_LABELS = 0.5
#: A similarity counts with this power, so that near neighbours outweigh the rest.
SHARPNESS = 20
SHAPE_WEIGHT = 0.5
#: Pairs are counted per so many.
PER = 1000
BLOCK = 256
#: Texts are read in pieces of so many bytes.
PIECE = 1 << 20

_GROUPS = ["0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",;:", "!?", "#*$%&", "|<>", "\"'`", "()[]{}"]
CLASSES = 64
_LENGTHS, _REPEATS, _VARIETY = 8, 6, 6
TERMS = CLASSES * CLASSES + _LENGTHS + _REPEATS + _VARIETY


def _byte_classes() -> np.ndarray:
    table = np.full(256, 63, np.uint16)
    for k in range(26):
        table[ord("a") + k] = k
        table[ord("A") + k] = 26 + k % 13
    for k, group in enumerate(_GROUPS):
        table[list(group.encode())] = 39 + k
    table[0x80:0xC0] = 52 + np.arange(64) % 8
    table[0xC0:] = 60 + np.arange(64) // 32
    return table


BYTE_CLASSES = _byte_classes()


def word_lists(text: str) -> Iterator[list[str]]:
    """The words of the whole text, in lists that are not empty: one of a short text, one a piece of a long one."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        words = text[at:end].split()
        if words:
            yield words
        at = end


def count_terms(text: str | None) -> np.ndarray:
    """Counts of all terms of the whole text."""
    out = np.zeros(TERMS, np.float32)
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    for at in range(0, max(len(raw) - 1, 0), PIECE):
        classes = BYTE_CLASSES[raw[at:at + PIECE + 1]]
        out[:CLASSES * CLASSES] += np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=CLASSES * CLASSES)
    n, repeated, seen, last = 0, 0, set(), [""]
    for words in word_lists(text):
        n += len(words)
        repeated += sum(map(eq, words, last + words))
        seen.update(words)
        last = words[-1:]
    at = CLASSES * CLASSES
    out[at + min(n.bit_length() // 3, _LENGTHS - 1)] = 1
    if n:
        out[at + _LENGTHS + min(int(repeated / n * 2 * _REPEATS), _REPEATS - 1)] = 1
        out[at + _LENGTHS + _REPEATS + min(int(len(seen) / n * _VARIETY), _VARIETY - 1)] = 1
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logs of the pairs' shares times idf, so that long and short texts compare; pairs and shape each scaled to a fixed length."""
    split = CLASSES * CLASSES
    x = counts.copy()
    x[:, :split] *= PER / np.maximum(x[:, :split].sum(axis=1, keepdims=True), 1)
    np.log1p(x, out=x)
    x *= idf
    for part, weight in ((x[:, :split], 1.0), (x[:, split:], SHAPE_WEIGHT)):
        norm = np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]
        part *= weight / np.maximum(norm, 1e-12)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


class Model:
    """Idf, projection, labelled vectors and labels: about (TERMS + SAMPLE) * RANK floats."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7):
        seen = (counts > 0).sum(axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + np.float32(1)
        x = weigh(counts, self.idf)
        # randomised range finder with power iterations
        basis = x.T @ np.random.default_rng(seed).standard_normal((len(x), min(rank + 16, len(x)))).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ np.linalg.qr(basis)[0]))[0]
        _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
        self.projection = np.ascontiguousarray((basis @ vt.T)[:, :rank], np.float32)
        self.vectors = unit(x @ self.projection)
        self.labels = labels.astype(np.float32)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Exact cosines with all labelled vectors, then the weighted share of label 1 among the nearest."""
        similar = unit(weigh(counts, self.idf) @ self.projection) @ self.vectors.T
        k = min(neighbours, similar.shape[1])
        nearest = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, nearest, axis=1), 1e-6).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[nearest]).sum(axis=1) / weight.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most ``sample`` labelled rows that are not held out; only their term counts come to the driver."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")  # sample rows of two numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [zlib.compress(count_terms(t.as_py()).tobytes(), 1) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array(vectors, pa.binary())], names=["quality", "vector"])

    rows = texts.mapInArrow(count, "quality double, vector binary").orderBy(F.xxhash64("vector")).limit(sample).collect()
    if not rows:
        return None
    counts, qualities = np.empty((len(rows), TERMS), np.float32), np.array([r.quality for r in rows])
    for k, r in enumerate(rows):
        counts[k] = np.frombuffer(zlib.decompress(r.vector), np.float32)
    del rows
    return Model(counts, qualities)


def scored(docs: DataFrame, model: Model | None, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` with the score as ``name``, which replaces a column of that name. Only texts go to Python, only scores come back."""
    if model is None:
        return docs.withColumn(name, F.lit(NO_LABELS))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [np.zeros(0)]
            for at in range(0, len(texts), BLOCK):
                parts.append(shared.value.score(np.stack([count_terms(t.as_py()) for t in texts[at:at + BLOCK]])))
            yield pa.array(np.concatenate(parts), pa.float64())
        give_back()

    return docs.withColumn(name, score("text"))
