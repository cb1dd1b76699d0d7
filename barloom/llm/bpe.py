"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode by an incremental UTF-8 machine.

Encoding. The tokens of every prefix of a piece are known: the last one is the only vocabulary suffix that stands in a stable
pair with the last token of the prefix before it (a pair is stable if BPE of its bytes gives just the two). A state of
the transducer is what of the prefixes' tokens is still open: the last token sent, the bytes since, and their prefixes' last
tokens. A byte leads to a new state and sends the tokens on which all continuations agree, that is those before every
place where a token may still be growing; this lookahead is shorter than the longest token. States and moves are made
when first needed and kept up to a limit, then forgotten and made anew.

Defined results: a null or empty text has no tokens. Special tokens are ordinary text. Rows are encoded one by one, other
columns pass through.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import give_back

MAX_STATES = 90_000
#: A state's moves are made when one was missing so often; before, and for as many bytes at once, its open places are followed.
LEAST_ASKED, AHEAD = 3, 48
#: Pieces in each of two generations of the memory.
MAX_PIECES = 100_000
#: Rows handed on at once.
ROWS = 250
#: Bytes handed to the UTF-8 machine at once.
DECODE_BYTES = 1 << 16


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_bytes(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """BPE by its definition: the leftmost pair of lowest rank is merged until none has one."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class State(dict):
    """The next state by byte.

    ``places``: the current end, then where open tokens may start, longest first; a place is (place where its last token starts, that token,
    number of tokens since the last sent one), and the first one of all holds the last sent token. ``sent``: tokens sent on the way here.
    ``asked``: how often a move was missing.
    """

    __slots__ = ("node", "places", "sent", "end", "asked")


class Stable(dict):
    """Whether a token is stable behind another one, looked up when first asked; behind the beginning (-1) it is."""

    __slots__ = ("stays", "token")

    def __init__(self, stays: Callable[[int, int], bool], token: int):
        self.stays, self.token = stays, token
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[-1] = True

    def __missing__(self, last: int) -> bool:
        ok = self[last] = self.stays(last, self.token)
        return ok


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.longest = max(map(len, ranks))
        self.growing = {token[:i] for token in ranks for i in range(1, len(token))}
        self._merges()
        self.clear()

    def clear(self) -> None:
        """No states and no vocabulary nodes made yet."""
        self.nodes: dict[bytes, int] = {}
        self.node_bytes: list[bytes] = []
        self.node_ends: list[tuple[list[tuple[int, int]], list[int]]] = []
        #: 256 * node + byte: next node; the tokens that may end here, longest first, as (number of the open place they start at, bytes, token, its pairs);
        #: the numbers of the open places that stay open
        self.node_moves: dict[int, tuple[int, tuple[tuple[int, int, int, Stable], ...], tuple[int, ...]]] = {}
        #: by the second token of a pair
        self.stable: dict[int, Stable] = {}
        self._node(b"")
        self._forget()

    def _merges(self) -> None:
        """The last merge that makes each token; single bytes have none."""
        self.made_of: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i], rank), self.ranks.get(token[i:], rank)
                if left < rank and right < rank and self._stays(left, right, rank):
                    self.made_of[rank] = left, right
                    self.merge[left, right] = rank
                    break

    def _stays(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether no merge under ``limit`` happens across the border of two tokens that are next to each other.

        Undoes the later of the two tokens' last merges again and again: before it, only the part at the border was there,
        and could have merged with the other side if that merge ranks lower.
        """
        while True:
            if self.merge.get((left, right), limit) < limit:
                return False
            a, b = self.made_of.get(left), self.made_of.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = min(limit, left), a[1]
            else:
                limit, right = min(limit, right + 1), b[0]

    def _forget(self) -> None:
        for state in getattr(self, "index", {}).values():  # they lead to each other in circles
            state.clear()
        self.index: dict[tuple, State] = {}
        for pairs in self.stable.values():  # moves hold them
            pairs.forget()
        self.n_stable = 0
        if len(self.node_moves) > 4 * self.max_states:
            self.node_moves.clear()
        self.start = self._state(0, ((None, -1, 0),), ())

    def _full(self) -> bool:
        return len(self.index) > self.max_states or self.n_stable > 4 * self.max_states or len(self.node_moves) > 4 * self.max_states

    def _state(self, node: int, places: tuple, sent: tuple[int, ...]) -> State:
        key = node, places, sent
        state = self.index.get(key)
        if state is None:
            state = self.index[key] = State()
            state.node, state.places, state.sent, state.end, state.asked = node, places, sent, None, 0
        return state

    def _node(self, tail: bytes) -> int:
        """Vocabulary node: the longest end of ``tail`` that is a token's beginning, with the tokens and beginnings among its ends."""
        while tail not in self.nodes:
            if not tail or tail in self.ranks or tail in self.growing:
                ends = [tail[i:] for i in range(len(tail))]
                self.node_ends.append(([(len(e), self.ranks[e]) for e in ends if e in self.ranks], [len(e) for e in ends if e in self.growing]))
                self.node_bytes.append(tail)
                self.nodes[tail] = len(self.node_bytes) - 1
            else:
                tail = tail[1:]
        return self.nodes[tail]

    def _node_move(self, node: int, byte: int) -> tuple[int, tuple[tuple[int, int, int, Stable], ...], tuple[int, ...]]:
        number = {size: k for k, size in enumerate((0, *self.node_ends[node][1]))}
        at = self._node(self.node_bytes[node] + bytes((byte,)))
        endings, beginnings = self.node_ends[at]
        made = self.node_moves[256 * node + byte] = (
            at, tuple([(number[size - 1], size, token, self._pairs(token)) for size, token in endings]), tuple([number[size - 1] for size in beginnings]))
        return made

    def _run(self, node: int, places: tuple, part: bytes) -> tuple[int, tuple]:
        """Node and open places after ``part``, without making states; nothing is sent."""
        node_moves = self.node_moves
        if len(part) == 1:
            node, endings, open_still = node_moves.get(256 * node + part[0]) or self._node_move(node, part[0])
            for k, _, token, stable in endings:
                before = places[k]
                if stable[before[1]]:
                    break
            return node, ((before, token, before[2] + 1), *[places[k] for k in open_still])
        sizes = self.node_ends[node][1]
        at = sizes[0] if sizes else 0
        reached: list = [None] * at + [places[0]]  # by the number of bytes since the longest open place
        for size, place in zip(sizes, places[1:]):
            reached[at - size] = place
        for byte in part:
            at += 1
            node, endings, _ = node_moves.get(256 * node + byte) or self._node_move(node, byte)
            for _, size, token, stable in endings:
                before = reached[at - size]
                if stable[before[1]]:
                    break
            reached.append((before, token, before[2] + 1))
        return node, (reached[at], *[reached[at - size] for size in self.node_ends[node][1]])

    def _pairs(self, token: int) -> Stable:
        pairs = self.stable.get(token)
        if pairs is None:
            pairs = self.stable[token] = Stable(self._counted, token)
        return pairs

    def _counted(self, last: int, token: int) -> bool:
        self.n_stable += 1
        return self._stays(last, token)

    def _settled(self, node: int, places: tuple) -> State:
        """The state of these open places: what all of them share is sent."""
        base, others = places[0], places[1:]
        for place in others:
            while base is not place:
                if base[2] > place[2]:
                    base = base[0]
                else:
                    place = place[0]
        sent = self._tokens(base) if base[2] else ()
        # the last sent token says nothing any more if no token may start after it
        last = base[1] if any([place is base for place in others]) else -1
        if sent or last != base[1]:
            moved = {id(base): (None, last, 0)}
            places = tuple([self._rebased(place, moved) for place in places])
        return self._state(node, places, sent)

    def _rebased(self, place: tuple, moved: dict[int, tuple]) -> tuple:
        made = moved.get(id(place))
        if made is None:
            before = self._rebased(place[0], moved)
            made = moved[id(place)] = before, place[1], before[2] + 1
        return made

    @staticmethod
    def _tokens(place: tuple) -> tuple[int, ...]:
        out = []
        while place[2]:
            out.append(place[1])
            place = place[0]
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        if self._full():
            self._forget()
        state, out, at, end = self.start, [], 0, len(piece)
        while at < end:
            for byte in piece[at:] if at else piece:
                after = state.get(byte)
                if after is None:
                    break
                state = after
                at += 1
                if state.sent:
                    out += state.sent
            else:
                break
            if state.asked < LEAST_ASKED:  # few pieces come here: go on from the open places
                state.asked += 1
                stop = at + AHEAD
                node, places = self._run(state.node, state.places, piece[at:stop])
                if stop >= end:
                    out += self._tokens(places[0])
                    return out
                state = self._settled(node, places)
                at = stop
            else:
                after = state[byte] = self._settled(*self._run(state.node, state.places, piece[at:at + 1]))
                state = after
                at += 1
            if state.sent:
                out += state.sent
            if self._full():
                here = state.node, state.places, state.sent
                self._forget()
                state = self._state(*here)
        if state.end is None:
            state.end = self._tokens(state.places[0])
        out += state.end
        return out


class Memory(dict):
    """Ids, as bytes of 32-bit numbers, of the pieces asked for; a new one is looked up in the older generation, then encoded."""

    def __init__(self, encode: Callable[[bytes], list[int]], older: dict[str, bytes]):
        self.make, self.older = encode, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.make(piece.encode())).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    """Texts to ids: the pattern's pieces, each through the transducer, with a bounded memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.known = Memory(self.transducer.encode, {})

    def forget(self) -> None:
        """Give back what was learnt of texts: a worker that idles between tasks holds only the vocabulary."""
        self.known = Memory(self.transducer.encode, {})
        self.transducer.clear()

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > MAX_PIECES:  # pieces that come again move to the new generation
            self.known.older = {}
            self.known = Memory(self.transducer.encode, self.known)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.find(text))), np.int32)


class Utf8Machine:
    """Incremental UTF-8: bytes of an unfinished character at a chunk's end wait for the next chunk.

    The state is how many continuation bytes are missing; it only has to be followed over a chunk's last three bytes.
    """

    NEED = [0] * 0xC0 + [1] * 0x20 + [2] * 0x10 + [3] * 0x10

    def __init__(self) -> None:
        self.waiting = b""

    def feed(self, chunk: bytes) -> str:
        data = self.waiting + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            if self.NEED[byte] >= back:
                cut = len(data) - back
            break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to text: token bytes in chunks, fed to the UTF-8 machine."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token

    def decode(self, ids: list[int]) -> str:
        machine, parts = Utf8Machine(), []
        for k in range(0, len(ids), DECODE_BYTES // 4):
            parts.append(machine.feed(b"".join(map(self.table.__getitem__, ids[k:k + DECODE_BYTES // 4]))))
        return "".join([*parts, machine.finish()])


_ENCODERS: dict[int, tuple[Encoder, Decoder]] = {}


def _coder(data: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """This worker's coder, made once."""
    key = hash((data, pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks = parse_ranks(data)
        _ENCODERS[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _ENCODERS[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, checked: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``tokens`` (array of int). The vocabulary, of fixed size, is read once and broadcast.

    ``checked`` decodes the ids in the same task and adds ``decoded_sha256``, without a second Python worker or the decoded text.
    Added columns replace those of the same name. Only texts go to Python, and they do not come back.
    """
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("tokens array<int>, decoded_sha256 string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = _coder(shared.value, pattern)
        gc.disable()  # neither states nor pieces are in cycles, and looking through them takes a fifth of the time
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                offsets, parts, hashes = [0], [np.zeros(0, np.int32)], []
                for text in whole[at:at + ROWS]:
                    ids = encoder.encode(text.as_py() if text.is_valid else "")
                    parts.append(ids)
                    offsets.append(offsets[-1] + len(ids))
                    hashes.append(hashlib.sha256(decoder.decode(ids.tolist()).encode()).hexdigest() if checked else None)
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)))
                yield pa.StructArray.from_arrays([tokens, pa.array(hashes, pa.string())], names=["tokens", "decoded_sha256"])
        encoder.forget()
        gc.enable()
        give_back()

    added = ["tokens", "decoded_sha256"] if checked else ["tokens"]
    coded = docs.select(*[c for c in docs.columns if c not in added], run("text").alias("__coded"))
    return coded.select("*", *[F.col(f"__coded.{c}") for c in added]).drop("__coded")


def decode(tokens: DataFrame, rank_file: str) -> DataFrame:
    """All columns of ``tokens`` with ``decoded`` (string), which replaces a column of that name."""
    with open(rank_file, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(parse_ranks(shared.value))
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                yield pa.array([decoder.decode(row.values.to_numpy().tolist() if row.is_valid else []) for row in whole[at:at + ROWS]], pa.string())

    return tokens.withColumn("decoded", run("tokens"))
