"""Suffix-array dedup: bytes inside a string of ``LENGTH`` bytes that also starts in a document with a smaller id go.

Distribution. The windows (strings of ``LENGTH`` bytes) of a text are cut into pieces that share a minimiser, the smallest hash of
the ``K``-byte strings inside the window. Equal windows have equal minimisers, so they meet in one bucket. At first only
names travel: part of the minimiser, a hash of the piece's content, and the id. Of equal pieces all but those with the smallest id
go, whatever else the bucket holds, as their windows all start in that document. Only first holders of pieces whose
minimiser occurs with other content elsewhere ship bytes, to be sorted with the bucket's other pieces. Names are dealt as blocks
of numbers, and a task folds them block by block: it keeps one row per piece, however many documents hold it.

Sorting. The pieces of a bucket are suffix-sorted by linear grouping. Suffixes start in the group of their first byte. Groups are
processed in descending order: each suffix looks along previous-smaller pointers for the nearest suffix before it that
is not processed, which it extends to a longer Lyndon prefix, moving it to a higher group. When all are processed, a
group holds the suffixes with one Lyndon prefix. Then the groups emit their order ascending: a suffix, when its turn comes, appends those
whose Lyndon prefix ends where it starts to their group, so no ranks are ever renamed. Neighbours in the order that share
``LENGTH`` bytes are a class of equal windows, and its smallest id decides. All windows of a piece hold the bucket's ``K``-byte
string; where each piece has it once, it is sorted as one symbol, which no UTF-8 text contains.

A bucket of more than ``MAX_BUCKET`` pieces is never put into one task: its windows are exploded and grouped by Spark, which is
exact as well.

Defined results: a null text is empty. A null id stands below all ids. Rows with the same id do not remove from each other.
A text shorter than ``LENGTH`` loses nothing.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions, release, stored

LENGTH = 50
#: Long enough that texts seldom share a minimiser by chance.
K = 24
MAX_PIECE_WINDOWS = 64
MAX_BUCKET = 5000
#: Texts are hashed in blocks of so many bytes.
CHUNK = 1 << 18
#: Names sorted at once, at least, and rows of texts cut at once.
BLOCK, ROWS = 1 << 19, 500
NO_ID = -(1 << 63)
#: Neighbouring pieces of a text overlap in most of their bytes, which this codec finds.
CODEC = "zstd"
#: Stands for the string that all pieces of a bucket share.
SYMBOL = b"\xff"
_BASE, _ODD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(CHUNK + LENGTH, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(CHUNK + LENGTH, pow(_BASE, -1, 1 << 64), np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the K-byte string at every place."""
    part, width, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    h, covered = None, 0
    while width <= K:  # hashes of doubled width, of which K's binary digits are put together
        if K & width:
            h = part if h is None else part[:len(part) - covered] * np.uint64(pow(_BASE, covered, 1 << 64)) + h[width:]
            covered += width
        if 2 * width <= K:
            part = part[:-width] * np.uint64(power) + part[width:]
        power, width = power * power % (1 << 64), 2 * width
    return _mixed(h)


def _minimisers(h: np.ndarray) -> np.ndarray:
    """For every window start the smallest hash of the K-byte strings in the window."""
    span, width = LENGTH - K + 1, 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[:len(h) - (span - width)], h[span - width:]) if width < span else h


def _pieces_of_block(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    h = _hashes(data)
    m = _minimisers(h)
    begins = np.empty(len(m), bool)
    begins[0] = True
    np.not_equal(m[1:], m[:-1], out=begins[1:])
    ends = offsets[1:]
    edges = np.concatenate((offsets, ends[np.diff(offsets) >= LENGTH] - LENGTH + 1))
    begins[edges[edges < len(m)]] = True
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(m)))
    owner = np.searchsorted(offsets, first, "right") - 1
    inside = first + LENGTH <= ends[owner]
    first, count, owner = first[inside], count[inside], owner[inside]
    if len(count) and count.max() > MAX_PIECE_WINDOWS:
        parts = -(-count // MAX_PIECE_WINDOWS)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(np.repeat(count, parts) - inner * MAX_PIECE_WINDOWS, MAX_PIECE_WINDOWS)
        first, owner = np.repeat(first, parts) + inner * MAX_PIECE_WINDOWS, np.repeat(owner, parts)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _POWERS[:len(h)], out=sums[1:])
    content = (sums[first + count + (LENGTH - K)] - sums[first]) * _INVERSES[first]
    return owner, m[first], _mixed(content + count.astype(np.uint64) * _ODD), first, count


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, minimiser, name, first window, number of windows) of the pieces of texts that lie one behind the other.

    A text's pieces do not depend on its neighbours; their name is a hash of their content.
    """
    found, k, last = [], 0, len(offsets) - 1
    while k < last:
        at = offsets[k]
        after = max(int(np.searchsorted(offsets, at + CHUNK, "right")) - 1, k + 1)
        size = int(offsets[after] - at)
        for begin in range(0, size - LENGTH + 1, CHUNK) if size > CHUNK else (0,) if size >= LENGTH else ():
            end = min(begin + CHUNK + LENGTH - 1, size)
            owner, *columns, first, count = _pieces_of_block(data[at + begin:at + end], np.array([0, end - begin]) if size > CHUNK else offsets[k:after + 1] - at)
            own = offsets[k:after + 1] - at
            found.append((owner + k, *columns, first + begin - own[owner], count))
        k = after
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(map(np.concatenate, zip(*found)))


def suffix_order(strings: list[bytes]) -> tuple[bytes, list[int], list[int]]:
    """All suffixes of ``strings`` in order: (strings each followed by a gap byte, places in it, place of each string's gap).

    A string's end counts as smaller than any byte; equal suffixes of different strings stand next to each other.
    """
    text = b"\0".join(strings) + b"\0"
    n = len(text)
    left = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    groups: dict[bytes, list[int]] = {}
    gaps, at = [], 0
    for s in strings:
        left[at] = -1
        for i in range(at, at + len(s)):
            c = text[i:i + 1]
            if c in groups:
                groups[c].append(i)
            else:
                groups[c] = [i]
        at += len(s) + 1
        gaps.append(at - 1)
    prefixes = sorted(groups)
    group_of = [-1] * n  # set when a suffix is processed
    number = 0
    while prefixes:
        prefix = prefixes.pop()
        size = len(prefix)
        members = [i for i in groups.pop(prefix) if end[i] == i + size]  # others have moved on
        if not members:
            continue
        for i in members:
            group_of[i] = number
        number += 1
        if len(members) > 1:
            members.sort()
        moved = []
        for i in members:
            p = left[i]
            while p >= 0 and group_of[p] >= 0:
                p = left[p]
            left[i] = p
            if p >= 0:
                end[p] = end[i]
                if not moved or moved[-1] != p:
                    moved.append(p)
        for p in moved:
            longer = text[p:end[p]]
            if longer in groups:
                groups[longer].append(p)
            else:
                groups[longer] = [p]
                insort(prefixes, longer)
    # suffixes that wait for the one at the end of their Lyndon prefix, or for a gap: first and next, in text order
    first, following = [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        if group_of[i] >= 0:
            e = end[i]
            following[i] = first[e]
            first[e] = i
    emitted: list[list[int]] = [[] for _ in range(number)]
    for gap in gaps:
        c = first[gap]
        while c >= 0:
            emitted[group_of[c]].append(c)
            c = following[c]
    order: list[int] = []
    for own in reversed(emitted):
        for i in own:  # grows while it is read
            c = first[i]
            while c >= 0:
                emitted[group_of[c]].append(c)
                c = following[c]
        order += own
    return text, order, gaps


def smallest_ids(strings: list[bytes], ids: list[int], width: int = LENGTH) -> list[list[int]]:
    """For each window of each string the smallest id of the strings that hold an equal window."""
    text, order, gaps = suffix_order(strings)
    owner = [0] * len(text)
    at = 0
    for k, gap in enumerate(gaps):
        owner[at:gap - width + 1] = [k + 1] * (gap - width + 1 - at)  # 0 where no window starts
        at = gap + 1
    least = [0] * len(text)
    same: list[int] = []
    last = None
    for i in order:
        if not owner[i]:
            continue
        window = text[i:i + width]
        if window != last:
            if same:
                low = min([ids[owner[j] - 1] for j in same])
                for j in same:
                    least[j] = low
            same, last = [i], window
        else:
            same.append(i)
    if same:
        low = min([ids[owner[j] - 1] for j in same])
        for j in same:
            least[j] = low
    return [least[gap - len(s):gap - width + 1] for s, gap in zip(strings, gaps)]


def bucket_ids(strings: list[bytes], ids: list[int], middles: list[int]) -> list[list[int]]:
    """``smallest_ids`` of a bucket's pieces; ``middles``: the one place of the bucket's minimiser in each, or -1."""
    if min(middles) >= 0:
        shared = strings[0][middles[0]:middles[0] + K]
        if all([s[m:m + K] == shared for s, m in zip(strings, middles)]) and not any([SYMBOL in s for s in strings]):
            return smallest_ids([s[:m] + SYMBOL + s[m + K:] for s, m in zip(strings, middles)], ids, LENGTH - K + 1)
    return smallest_ids(strings, ids)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings or byte strings; null is empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of blocks of numbers."""
    data, offsets = _texts(column)
    return data.view(kind), offsets // np.dtype(kind).itemsize


def _blocks(key: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """One row per key: the key, and of each column the block of its numbers."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    out = [pa.array(key[starts])]
    for values in columns:
        offsets = (np.append(starts, len(key)) * values.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values[order])]))
    return out


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of each run of equal keys."""
    bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist()
    return ((int(keys[a]), a, b) for a, b in zip(bounds, bounds[1:]) if a < b)


def _names(buckets: int):
    """(id, text) to blocks (bucket, part of the minimiser, name, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            ids, h, names = map(np.concatenate, zip(*held))
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            return pa.RecordBatch.from_arrays(_blocks(bucket, h.astype(np.uint32), names, ids), names=["bucket", "h", "name", "id"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                owner, h, names, _, _ = pieces(*_texts(part.column(1)))
                held.append((part.column(0).to_numpy()[owner], h, names))
                size += len(h)
                if size >= BLOCK:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    return run


def _answers(groups: int):
    """Blocks in order of their bucket to blocks (group, id, name, wanted): pieces that go as a whole, and pieces wanted for sorting."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first, held, size, bucket = empty, [], 0, None  # first: each piece with its smallest id so far
        answers, n_answers = [], 0

        def answer(ids: np.ndarray, names: np.ndarray, wanted: bool) -> None:
            nonlocal n_answers
            if len(ids):
                answers.append((ids, names, np.full(len(ids), wanted, np.uint8)))
                n_answers += len(ids)

        def fold() -> None:
            nonlocal first, held, size
            h, names, ids = map(np.concatenate, zip(first, *held))
            held, size = [], 0
            order = np.argsort(names)
            new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
            other = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            if (other & ~new).any():  # one name for two minimisers
                order = np.lexsort((h, names))
                new = np.concatenate(([True], (names[order][1:] != names[order][:-1]) | (h[order][1:] != h[order][:-1])))
            names, ids, starts = names[order], ids[order], np.flatnonzero(new)
            low = np.minimum.reduceat(ids, starts)
            gone = ids > np.repeat(low, np.diff(np.append(starts, len(ids))))
            answer(ids[gone], names[gone], False)
            first = h[order][starts], names[starts], low

        def finish() -> None:
            nonlocal first
            if size:
                fold()
            h, names, ids = first
            first = empty
            if len(h):
                order = np.argsort(h)
                h, names, ids = h[order], names[order], ids[order]
                starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                wanted = np.repeat(np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts), np.diff(np.append(starts, len(h))))
                answer(ids[wanted], names[wanted], True)

        def block() -> pa.RecordBatch:
            nonlocal answers, n_answers
            ids, names, wanted = map(np.concatenate, zip(*answers))
            answers, n_answers = [], 0
            group = ((_mixed(ids.view(np.uint64) * _ODD) >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
            return pa.RecordBatch.from_arrays(_blocks(group, ids, names, wanted), names=["grp", "id", "name", "wanted"])

        for batch in batches:
            (h, at), (names, _), (ids, _) = (_numbers(batch.column(k), kind) for k, kind in ((1, np.uint32), (2, np.uint64), (3, np.int64)))
            for key, a, b in _runs(batch.column(0).to_numpy()):
                if key != bucket:
                    finish()
                    bucket = key
                    if n_answers >= BLOCK:
                        yield block()
                a, b = at[a], at[b]
                held.append((h[a:b].copy(), names[a:b].copy(), ids[a:b].copy()))
                size += b - a
                if size >= max(BLOCK, len(first[0])):
                    fold()
                    if n_answers >= BLOCK:
                        yield block()
        finish()
        if n_answers:
            yield block()

    return run


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their group to one row (id, gone, wanted) per id, with names."""
    held: list[tuple] = []
    group = None

    def rows() -> pa.RecordBatch:
        ids, names, wanted = map(np.concatenate, zip(*held))
        held.clear()
        order = np.argsort(ids)
        ids, names, wanted = ids[order], names[order], wanted[order]
        sides = [(ids[wanted == k], names[wanted == k]) for k in (0, 1)]
        ids = np.unique(ids)
        lists = [pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(i, ids), len(i)).astype(np.int32)), pa.array(n.view(np.int64))) for i, n in sides]
        return pa.RecordBatch.from_arrays([pa.array(ids), *lists], names=["id", "gone", "wanted"])

    for batch in batches:
        (ids, at), (names, _), (wanted, _) = (_numbers(batch.column(k), kind) for k, kind in ((1, np.int64), (2, np.uint64), (3, np.uint8)))
        for key, a, b in _runs(batch.column(0).to_numpy()):
            if key != group and group is not None:
                yield rows()
            group = key
            a, b = at[a], at[b]
            held.append((ids[a:b].copy(), names[a:b].copy(), wanted[a:b].copy()))
    if group is not None:
        yield rows()


CUT = "id long, node long, firsts array<int>, ends array<int>, h long, piece binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, text, gone, wanted) to ``CUT``: a text's runs that go, and its pieces to be sorted with their places."""
    def salted(names: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return names + rows.astype(np.uint64) * _ODD

    def asked(column: pa.Array) -> np.ndarray:
        sizes = column.value_lengths().fill_null(0).to_numpy()
        return salted(column.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(column)), sizes))

    def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)))

    def starts_of(keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            data, offsets = _texts(part.column(2))
            owner, h, names, first, count = pieces(data, offsets)
            names = salted(names, owner)
            gone, wanted = (np.isin(names, asked(part.column(k))) for k in (3, 4))
            ids, nodes = part.column(0), part.column(1)
            rows, a, b = owner[gone], first[gone], (first + count)[gone] + LENGTH - 1
            if len(rows):
                new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (a[1:] > b[:-1]))))
                a, b, rows = a[new], b[np.append(new[1:], len(b)) - 1], rows[new]
                starts = starts_of(rows)
                index = pa.array(rows[starts])
                yield pa.RecordBatch.from_arrays([ids.take(index), nodes.take(index), lists(a, starts), lists(b, starts), pa.nulls(len(starts), pa.int64()), pa.nulls(len(starts), pa.binary())],
                                                 names=["id", "node", "firsts", "ends", "h", "piece"])
            if wanted.any():
                order = np.flatnonzero(wanted)
                order = order[np.argsort(names[order], kind="stable")]
                starts = starts_of(names[order])
                one = order[starts]
                begin = offsets[owner[one]] + first[one]
                out = [data[s:s + c + LENGTH - 1].tobytes() for s, c in zip(begin.tolist(), count[one].tolist())]
                index = pa.array(owner[one])
                yield pa.RecordBatch.from_arrays([ids.take(index), nodes.take(index), lists(first[order], starts), pa.nulls(len(one), pa.list_(pa.int32())), pa.array(h[one].view(np.int64)), pa.array(out, pa.binary())],
                                                 names=["id", "node", "firsts", "ends", "h", "piece"])


RUNS = "id long, node long, firsts array<int>, ends array<int>"


def _middles(h: np.ndarray, column: pa.Array) -> list[int]:
    """The place of the minimiser in each piece that has it once, else -1."""
    data, offsets = _texts(column)
    places = np.flatnonzero(_hashes(data) == np.repeat(h.view(np.uint64), np.diff(offsets))[:len(data) - K + 1])
    row = np.searchsorted(offsets, places, "right") - 1
    inside = places + K <= offsets[row + 1]
    places, row = places[inside], row[inside]
    out = np.full(len(column), -1)
    out[row] = places - offsets[row]
    out[np.bincount(row, minlength=len(column)) != 1] = -1
    return out.tolist()


def _bucket_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, piece, id, node, firsts) in order of h to ``RUNS``; a bucket ends where h changes, and may run over batches."""
    held: list[tuple] = []
    bucket = None

    def runs(rows: list[tuple]) -> Iterator[tuple]:
        strings, ids, nodes, firsts, middles = map(list, zip(*rows))
        if min(ids) == max(ids):
            return
        for own, node, places, least in zip(ids, nodes, firsts, bucket_ids(strings, ids, middles)):
            spans, since = [], None
            for j, low in enumerate(least):
                if low < own:
                    if since is None:
                        since = j
                elif since is not None:
                    spans.append((since, j))
                    since = None
            if since is not None:
                spans.append((since, len(least)))
            if spans:
                yield own, node, [p + a for p in places for a, _ in spans], [p + b + LENGTH - 1 for p in places for _, b in spans]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["id", "node", "firsts", "ends"])

    for batch in batches:
        found: list[tuple] = []
        middles = _middles(batch.column(0).to_numpy(), batch.column(1)) if batch.num_rows else []
        for h, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), middles):
            if h != bucket and held:
                found += runs(held)
                held = []
            bucket = h
            held.append(row)
        if found:
            yield batch_of(found)
    if held and (found := list(runs(held))):
        yield batch_of(found)


def _answered(docs: DataFrame) -> DataFrame:
    """(id, gone, wanted): names of the pieces that go as a whole and of those to be sorted."""
    n = partitions(docs.sparkSession)
    asked = docs.select("id", "text").mapInArrow(_names(8 * n), "bucket int, h binary, name binary, id binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    answers = asked.mapInArrow(_answers(4 * n), "grp int, id binary, name binary, wanted binary").repartition(n, "grp").sortWithinPartitions("grp")
    return stored(answers.mapInArrow(_by_text, "id long, gone array<long>, wanted array<long>"), "suffix-answers", CODEC)


def _shipped(docs: DataFrame, answered: DataFrame) -> DataFrame:
    return stored(docs.join(answered, "id").select("id", "node", "text", "gone", "wanted").mapInArrow(_cut, CUT), "suffix-pieces", CODEC)


def _removed(docs: DataFrame) -> DataFrame:
    """(id, node, firsts, ends): lists of the byte ranges to remove, not merged. ``docs``: id, node, text."""
    spark = docs.sparkSession
    answered = _answered(docs)
    release(spark)
    cut = _shipped(docs, answered)
    release(spark, answered)
    shipped = cut.where("h IS NOT NULL").select("h", "piece", "id", "node", "firsts")
    # written first, so that Spark knows its size and does not deal the pieces by h to join it if it is small
    large = stored(shipped.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > MAX_BUCKET).select("h"), "suffix-large")
    by_order = shipped.join(large, "h", "left_anti").repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_bucket_results, RUNS)
    windows = shipped.join(large, "h", "left_semi").select("piece", "id", "node", "firsts", F.explode(F.sequence(F.lit(1), F.length("piece") - LENGTH + 1)).alias("at"))
    windows = windows.withColumn("window", F.substring(F.col("piece"), F.col("at"), F.lit(LENGTH)))
    least = windows.groupBy("window").agg(F.min("id").alias("low"))
    hits = windows.drop("piece").join(least, "window").where("low < id")
    by_window = hits.select("id", "node", F.expr("transform(firsts, p -> p + at - 1)").alias("firsts"), F.expr(f"transform(firsts, p -> p + at + {LENGTH - 1})").alias("ends"))
    runs = cut.where("h IS NULL").select("id", "node", "firsts", "ends").unionByName(by_order).unionByName(by_window)
    removed = stored(runs.groupBy("id", "node").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("ends")).alias("ends")), "suffix-runs", CODEC)
    release(spark, cut, large)
    return removed


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, spans, kept = [], [], [], []
        for text, firsts, ends in zip(*(batch.column(k) for k in (1, 2, 3))):
            raw = (text.as_py() or "").encode()
            total.append(len(raw))
            if not firsts.is_valid:
                gone.append(0)
                spans.append(0)
                kept.append(raw)
                continue
            a, b = firsts.values.to_numpy(), ends.values.to_numpy()
            depth = np.zeros(len(raw) + 1, np.int32)
            np.add.at(depth, a, 1)
            np.add.at(depth, b, -1)
            removed = np.cumsum(depth[:-1]) > 0
            gone.append(int(removed.sum()))
            spans.append(int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~removed].tobytes())
        columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (total, gone, spans)), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` are the remaining bytes, which may cut a character."""
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("node"), "text")
    removed = _removed(keyed.select("id", "node", "text"))
    return keyed.join(removed, ["id", "node"], "left").select("doc_id", "text", "firsts", "ends").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
