"""Alignment of two tokenisations of a text by whitespace-token anchors and memoised windows.

Each text is tokenised whole by both vocabularies: A (byte-level BPE, whose ids follow its merges, which is checked, so that ids are ranks)
encodes a space and the text, B (pieces with byte fallback)
the text, to which it adds that space. Where both have a token that begins with a space at the same byte, and so both have a token that ends there, is an
anchor; that the ends agree is checked on the running byte counts. Between anchors lie windows of few tokens. How a window's
tokens group, and which of its ends meet, depends on its ids alone, so it is worked out once for each pair of id tuples and remembered,
in two generations of bounded size.

A link is a pair of occurrences whose byte ranges end together, which is one a group, as no token is empty. How often the corpus holds an id pair linked is
counted over all documents: each keeps its distinct pairs with their numbers, Spark sums them. Pairs with a count of at least a
``1 / FREQUENT`` part of all links are at most ``FREQUENT`` and go to all tasks; rarer ones, none of which is
frequent enough to be a hot key, are met by a join.

Defined results: a null or empty text, and one whose tokens don't spell it (a literal U+2581 read as a space, characters the
pieces lose), has no tokens. Special tokens inside texts are plain text. Rows are aligned one by one; null or
repeated ids keep a row each.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from barloom.llm.common import stored

#: Windows in each of two generations of the memory.
MAX_WINDOWS = 400_000
#: Tokens of a window up to which it is remembered.
MAX_REMEMBERED = 64
FREQUENT = 500_000
ROWS = 64


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    def __init__(self, file_a: bytes, file_b: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        alphabet = byte_alphabet()
        model = json.loads(file_a)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        made = [ranks[b"".join(bytes(alphabet[c] for c in part) for part in (m if isinstance(m, list) else m.split(" ")))] for m in model["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the merges of A must make tokens of rising ids, so that ids are ranks")
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            bytes_a[i] = token
        bytes_b = [bytes((int(self.b.id_to_piece(i)[3:5], 16),)) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.bytes_b = bytes_b
        self.lengths_a, self.lengths_b = list(map(len, bytes_a)), list(map(len, bytes_b))
        self.names = list(map(str, range(max(len(bytes_a), len(bytes_b)))))
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        self.marks_a, self.marks_b = (np.array([x[:1] == b" " for x in t]) for t in (bytes_a, bytes_b))
        self.known: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}
        self.older: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A and B; none where B doesn't spell a space and the text (A always does)."""
        if text:
            b = self.b.encode(text, num_threads=1)
            if b"".join(map(self.bytes_b.__getitem__, b)) == b" " + text.encode():
                return self.a.encode_to_numpy(" " + text, disallowed_special=()), np.array(b, np.uint32)
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def window(self, a: bytes, b: bytes) -> tuple[str, bytes]:
        """Groups of a window of ids, as text, and the linked pairs, the last ids of each group: both byte counts run until they agree."""
        a, b = array("I", a).tolist(), array("I", b).tolist()
        lengths_a, lengths_b, names = self.lengths_a, self.lengths_b, self.names
        parts, pairs = [], []
        j, last = 0, len(b)
        text = carried = ""  # ids of A and of B in the group so far
        ahead = 0  # bytes by which A's tokens are ahead of B's
        for x in a:
            text = f"{text},{names[x]}" if text else names[x]
            ahead += lengths_a[x]
            while ahead > 0 and j < last:
                y = b[j]
                ahead -= lengths_b[y]
                carried = f"{carried},{names[y]}" if carried else names[y]
                j += 1
            if not ahead:
                parts.append(f"{text}|{carried}")
                pairs.append((b[j - 1] << 32) + x)
                text = carried = ""
        return ";".join(parts), array("q", pairs).tobytes()

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the tokens, other than the first, that begin with a space at the same byte in both."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        marked_a, marked_b = np.flatnonzero(self.marks_a[a[1:]]), np.flatnonzero(self.marks_b[b[1:]])
        _, at_a, at_b = np.intersect1d(ends_a[marked_a], ends_b[marked_b], assume_unique=True, return_indices=True)
        return marked_a[at_a] + 1, marked_b[at_b] + 1

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray]:
        """Groups as text, and the linked pairs, 2 ** 32 * B id + A id."""
        cuts_a, cuts_b = self.anchors(a, b)
        if len(self.known) > MAX_WINDOWS:  # windows that come again move to the new generation
            self.older, self.known = self.known, {}
        known, older, texts, pairs = self.known, self.older, [], []
        raw_a, raw_b = a.tobytes(), b.tobytes()
        i = j = 0
        for end_i, end_j in zip([*(4 * cuts_a).tolist(), len(raw_a)], [*(4 * cuts_b).tolist(), len(raw_b)]):
            key = raw_a[i:end_i], raw_b[j:end_j]
            part = known.get(key)
            if part is None:
                part = older.get(key) or self.window(*key)
                if end_i - i + end_j - j <= 4 * MAX_REMEMBERED:
                    known[key] = part
            texts.append(part[0])
            pairs.append(part[1])
            i, j = end_i, end_j
        return ";".join(texts), np.frombuffer(b"".join(pairs), np.int64)


_ALIGNERS: dict[int, Aligner] = {}


def _aligner(files: tuple[bytes, bytes, str]) -> Aligner:
    """This worker's aligner, made once."""
    key = hash(files)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*files)
    return _ALIGNERS[key]


def align(docs: DataFrame, file_a: str, file_b: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, numbers) of every row of ``docs`` (doc_id, text).

    ``pairs`` are the distinct linked id pairs of the text, 2 ** 32 * B id + A id, and ``numbers`` how often each is linked there.
    The two vocabulary files, of fixed size, are read by the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Path(file_a).read_bytes(), Path(file_b).read_bytes(), pattern))
    docs = docs.select("doc_id", "text")
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, numbers array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        gc.disable()  # windows are not in cycles, and looking through them takes a third of the time
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows, pairs, numbers = [], [], []
                for text in batch.column(1).to_pylist():
                    a, b = aligner.tokens(text or "")
                    groups, linked = aligner.align(a, b) if len(a) else ("", np.zeros(0, np.int64))
                    rows.append((len(a), len(b), len(linked), len(linked), hashlib.sha256(groups.encode()).hexdigest() if len(a) else ""))
                    own, often = np.unique(linked, return_counts=True)
                    pairs.append(own)
                    numbers.append(often.astype(np.int32))
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.string()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(pairs))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(numbers)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "numbers"])
        gc.enable()

    return docs.mapInArrow(run, out)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best) of every linked id pair of the corpus: how often it is linked, and whether no pair of its B id is more often."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "numbers")).alias("p")).select("p.pairs", "p.numbers")
    counts = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("numbers").alias("links")), "align-counts")
    b = F.shiftright("pair", 32)
    top = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return stored(counts.withColumn("b", b).join(top, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "align-best")


def summed(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` without its pairs, with ``n_best`` and ``count_sum``."""
    spark = aligned.sparkSession
    links = counts.agg(F.sum("links")).first()[0] or 0
    least = links // frequent + 1
    often = counts.where(F.col("links") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast((often["pair"].to_numpy(), often["links"].to_numpy(), often["best"].to_numpy(zero_copy_only=False)))
    keep = [f for f in aligned.schema.fields if f.name not in ("pairs", "numbers")]
    out = StructType([*keep, StructField("n_best", LongType()), StructField("count_sum", LongType()), StructField("pairs", ArrayType(LongType())), StructField("numbers", ArrayType(IntegerType()))])

    def run(batches):
        keys, counted, best = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                named = dict(zip(batch.schema.names, batch.columns))
                sizes = np.diff(named["pairs"].offsets.to_numpy())
                pairs, numbers = named["pairs"].flatten().to_numpy(), named["numbers"].flatten().to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                here = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                sums = [np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)]
                np.add.at(sums[0], row[here], numbers[here] * best[at[here]])
                np.add.at(sums[1], row[here], numbers[here] * counted[at[here]])
                left = pa.array(np.cumsum([0, *np.bincount(row[~here], minlength=len(sizes))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(named[f.name] for f in keep), *map(pa.array, sums), pa.ListArray.from_arrays(left, pa.array(pairs[~here])), pa.ListArray.from_arrays(left, pa.array(numbers[~here].astype(np.int32)))],
                    names=out.names)

    rows = aligned.mapInArrow(run, out)
    rare = counts.where(F.col("links") < least)
    if rare.isEmpty():
        return rows.drop("pairs", "numbers")
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "align-rows")
    each = rows.select("__row", F.explode(F.arrays_zip("pairs", "numbers")).alias("p")).select("__row", F.col("p.pairs").alias("pair"), "p.numbers")
    more = each.join(rare, "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("numbers")).otherwise(0)).alias("__best"), F.sum(F.col("numbers") * F.col("links")).alias("__sum"))
    return rows.join(more, "__row", "left").select(
        *(f.name for f in keep), (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"))


def alignment_statistics(docs: DataFrame, file_a: str, file_b: str, pattern: str, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row of ``docs``."""
    aligned = stored(align(docs, file_a, file_b, pattern), "align-docs")
    return summed(aligned, pair_counts(aligned), frequent)
