"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The items, cut into blocks of bounded bytes, become one automaton a block; training texts stream through it word by word, and
the state with its matched length tells the longest part of any item that ends at the word. A length of ``window`` or more
means that an item's window ends here; its items hang on the state. Items shorter than a window count as a whole.

A text only enters the automaton in runs of words whose neighbouring pairs all occur in items: every window lies inside
such a run, so nothing is lost, and ordinary text costs a table look-up a word.

Defined results: null and empty texts and items have no words. Repeated item rows count once by their id; a null id
counts as the id ''. Every document row is judged by itself. Other columns pass through unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from barloom.llm.common import give_back, stored

WINDOW = 10
#: Bytes of item text in one automaton: what is broadcast at once is bounded by this, further items take further passes.
BLOCK_BYTES = 4 << 20
#: Automata that a task reads one after the other in one pass.
BLOCKS_AT_ONCE = 8
#: Spans longer than so many words are cut, shorter ones stay; texts with more than this share of hit words go.
MAX_SPAN_WORDS = 9
MAX_COVERAGE = 0.5
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class ItemAutomaton:
    """Generalised suffix automaton of items: (id, words). States are indices into parallel lists."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, ids in sequences:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.items_at: list[set[str]] = [set() for _ in self.next]
        self.short_at: list[dict[int, set[str]]] = [{} for _ in self.next]
        for item, ids in sequences:
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= window:
                    self.items_at[self._of_length(state, window)].add(item)
            if len(ids) < window:
                self.short_at[self._of_length(state, len(ids))].setdefault(len(ids), set()).add(item)
        # states whose suffix links lead to a short item
        self.leads_short = [bool(s) for s in self.short_at]
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.leads_short[v] |= self.leads_short[self.link[v]]
        self.least = min([window, *(len(ids) for _, ids in sequences)])
        pairs = {(a, b) for _, ids in sequences for a, b in zip(ids, ids[1:])}
        size = 1 << max(16, (16 * len(pairs)).bit_length())
        self.pair_mask = size - 1
        self.pair_known = np.zeros(size, bool)
        if pairs:
            both = np.array(sorted(pairs), np.int64)
            self.pair_known[(both[:, 0] * 40503 + both[:, 1]) & self.pair_mask] = True

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The part of state ``q`` that is reached from ``p`` by ``c`` with the length that ``p`` allows."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p != -1:
            self.link[state] = self._split(p, self.next[p][c], c)
        return state

    def _of_length(self, state: int, n: int) -> int:
        """The state on the suffix links of ``state`` that holds its suffix of ``n`` words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Word ranges that can hold a window: all words, and all pairs of neighbours, are known."""
        known = ids >= 0
        if self.least <= 1:
            ok, extra = known, 0
        else:
            a = ids.astype(np.int64)
            ok, extra = known[:-1] & known[1:] & self.pair_known[(a[:-1] * 40503 + a[1:]) & self.pair_mask], 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + extra
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Merged hit spans, flat (start, end, start, end, ...) in words, and the items whose windows occur."""
        if len(words) < self.least or not self.vocabulary:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        spans: list[int] = []
        items: set[str] = set()
        nexts, link, length, window = self.next, self.link, self.length, self.window

        def hit(start: int, end: int) -> None:
            while spans and spans[-1] >= start:
                start = min(start, spans[-2])
                del spans[-2:]
            spans.extend((start, end))

        for start, end in self.runs(ids):
            state = matched = 0
            for k, c in enumerate(ids[start:end].tolist(), start + 1):
                while state and c not in nexts[state]:
                    state = link[state]
                    matched = length[state]
                if c not in nexts[state]:
                    matched = 0
                    continue
                state, matched = nexts[state][c], matched + 1
                if self.leads_short[state]:
                    v = state
                    while v > 0:
                        for n, found in self.short_at[v].items():
                            if n <= matched:
                                hit(k - n, k)
                                items |= found
                        v = link[v]
                if matched >= window:
                    hit(k - window, k)
                    items |= self.items_at[self._of_length(state, window)]
        return spans, items


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of about ``block_bytes`` of text at most, each collected by itself."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 if total <= block_bytes else 2 * (-(-total // block_bytes))
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, words_of(r.text)) for r in block.collect()]


def automata(items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The automaton of each block of items, broadcast."""
    return [items.sparkSession.sparkContext.broadcast(ItemAutomaton(block, window)) for block in item_blocks(items, block_bytes)]


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``word_count``, ``hit_spans`` (flat starts and ends, in words, merged) and ``hit_items`` (sorted ids).

    Added columns replace those of the same name. Nothing is shuffled. A task holds ``BLOCKS_AT_ONCE`` automata at most:
    with more blocks the rows are stored after each group of them.
    """
    return matched(docs.drop("word_count", "hit_spans", "hit_items"), automata(items, window, block_bytes))


def matched(docs: DataFrame, shared_blocks: list[Broadcast]) -> DataFrame:
    """``matches`` for automata that are already broadcast."""
    out = StructType([*docs.schema, StructField("word_count", LongType()), StructField("hit_spans", ArrayType(LongType())), StructField("hit_items", ArrayType(StringType()))])
    found = docs.select("*", F.lit(0).cast("long").alias("word_count"), F.array().cast("array<bigint>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    for k in range(0, len(shared_blocks), BLOCKS_AT_ONCE):

        def scan(batches: Iterator[pa.RecordBatch], group=tuple(shared_blocks[k:k + BLOCKS_AT_ONCE])) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, spans, names = [], batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                    words = words_of(text.as_py())
                    counts.append(len(words))
                    for shared in group:
                        new_spans, new_items = shared.value.scan(words)
                        spans[i] = merged(spans[i], new_spans) if spans[i] and new_spans else spans[i] or new_spans
                        names[i] = sorted({*names[i], *new_items})
                columns = batch.columns[:-3] + [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            give_back()

        found = (stored(found, "matches") if k else found).mapInArrow(scan, out)
    return found


def merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two flat span lists."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and out[-1] >= start:
            out[-1] = max(out[-1], end)
        else:
            out.extend((start, end))
    return out


def without_spans(text: str, spans: list[int], max_span_words: int) -> str:
    """``text`` without the bytes from the first to the last word of each span of more than ``max_span_words`` words."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    kept, at = [], 0
    for start, end in zip(spans[::2], spans[1::2]):
        if end - start > max_span_words:
            kept.append(raw[at:places[start][0]])
            at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def cut_text(text: str | None, scan, max_span_words: int, max_coverage: float) -> tuple[bool, str | None]:
    """Whether the text goes, and what is left of it if anything was cut."""
    words = words_of(text)
    n, gone, left, spans = len(words), 0, None, scan(words)[0]
    while spans:
        if gone + sum(spans[1::2]) - sum(spans[::2]) > max_coverage * n:
            return True, None
        long = sum(e - b for b, e in zip(spans[::2], spans[1::2]) if e - b > max_span_words)
        if not long:
            break
        left = without_spans(text if left is None else left, spans, max_span_words)
        gone += long
        spans = scan(words_of(left))[0]
    return False, left


def _cut_alone(docs: DataFrame, shared: Broadcast, max_span_words: int, max_coverage: float) -> DataFrame:
    """``decontaminate`` for one automaton: one Python pass that only texts enter and only changed texts leave."""

    @F.arrow_udf("gone boolean, changed string")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [cut_text(t.as_py(), shared.value.scan, max_span_words, max_coverage) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([g for g, _ in rows], pa.bool_()), pa.array([c for _, c in rows], pa.string())], names=["gone", "changed"])
        give_back()

    found = docs.select("*", cut("text").alias("__cut")).where("NOT __cut.gone")
    return found.withColumn("text", F.coalesce("__cut.changed", "text")).drop("__cut")


def decontaminate(docs: DataFrame, items: DataFrame, max_span_words: int = MAX_SPAN_WORDS, max_coverage: float = MAX_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs``: spans over the length limit are cut from ``text``, texts over the coverage limit go.

    A cut joins words that were apart, so what is left is searched again until no span over the limit is found; words cut
    before count as hit. Shorter spans, those of whole short items, stay. One automaton is searched again at once; with
    more, the texts that were cut make further rounds over all of them.
    """
    blocks = automata(items, WINDOW, block_bytes)
    if len(blocks) == 1:
        return _cut_alone(docs, blocks[0], max_span_words, max_coverage)
    named, docs = docs.columns, docs.toDF(*[c if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)])
    schema = docs.schema
    # words at the start (null before the first round), words cut so far, whether to search again
    state = [StructField("_words", LongType()), StructField("_cut", LongType()), StructField("_again", BooleanType())]
    full = StructType([*schema, *state])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, width = batch.schema.get_field_index("text"), batch.num_columns - 6
            words, gone, _, counts, spans, _ = (c.to_pylist() for c in batch.columns[width:])
            texts, again, keep = batch.column(at), [False] * batch.num_rows, [True] * batch.num_rows
            changed = {}
            for i, s in enumerate(spans):
                words[i] = counts[i] if words[i] is None else words[i]
                if s:
                    if gone[i] + sum(s[1::2]) - sum(s[::2]) > max_coverage * words[i]:
                        keep[i] = False
                        continue
                    long = sum(e - b for b, e in zip(s[::2], s[1::2]) if e - b > max_span_words)
                    if not long:
                        continue
                    changed[i] = without_spans(changed[i] if i in changed else texts[i].as_py(), s, max_span_words)
                    gone[i] += long
                    again[i] = True
            columns = batch.columns[:width]
            if changed:
                columns[at] = pa.array([changed[i] if i in changed else t.as_py() for i, t in enumerate(texts)], texts.type)
            columns += [pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(again, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-3]).filter(pa.array(keep, pa.bool_()))

    def one_round(rows: DataFrame) -> DataFrame:
        return matched(rows, blocks).mapInArrow(cut, full)

    rows = one_round(docs.select("*", F.lit(None).cast("long").alias("_words"), F.lit(0).cast("long").alias("_cut"), F.lit(False).alias("_again")))
    rows = stored(rows, "decontaminated")
    done = rows.where("NOT _again")
    rows = rows.where("_again")
    while not rows.isEmpty():
        rows = stored(one_round(rows), "decontaminated")
        done = done.unionAll(rows.where("NOT _again"))
        rows = rows.where("_again")
    return done.select(*schema.names).toDF(*named)
