"""Byte-level BPE: texts to token numbers and back, by replaying the merges over a whole batch of words."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A task forgets its known pieces when there are this many, and never keeps pieces of more bytes.
KNOWN_PIECES, LONG_PIECE = 400_000, 64
#: Texts are cut into pieces, and new pieces merged, when this many characters of texts are together.
TOGETHER = 4 << 20
#: Bytes of new pieces that are merged together, and places from which on a merge works on vectors.
LOT, MANY = 1 << 20, 24


class Ranks:
    """A rank file: each line a token's bytes in base64 and its number, which is also its merge rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.number = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.token = {rank: token for token, rank in self.number.items()}
        self.single = np.array([self.number.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.byte_pairs = np.array([[self.number.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)
        self.made: dict[int, int] = {}
        size = max(self.token, default=-1) + 1
        self.length = np.zeros(size, np.int64)
        for rank, token in self.token.items():
            self.length[rank] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(size)), np.uint8)

    def pair(self, left: int, right: int) -> int:
        """The token that two neighbours make, or -1."""
        key = left << 32 | right
        rank = self.made.get(key)
        if rank is None:
            rank = self.made[key] = self.number.get(self.token[left] + self.token[right], -1)
        return rank

    def decode(self, numbers: np.ndarray) -> bytes:
        """The bytes of a list of token numbers."""
        if not len(numbers):
            return b""
        if numbers.min() < 0 or numbers.max() >= len(self.length) or not self.length[numbers].all():
            raise ValueError("a token number is not in the rank file")
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.bytes[at].tobytes()


class Replay:
    """Symbols of many pieces in one list, and the index from each pair of neighbours to its places.

    A pair is named by the token it makes. ``stands`` holds for each place the pair that begins there, or -1;
    an entry of the index is stale if ``stands`` says otherwise by now. The arrays are linked lists by place,
    seen both as plain arrays and, for merges with many places, as vectors.
    """

    def __init__(self, pieces: list[bytes], ranks: Ranks):
        self.pair, data = ranks.pair, np.frombuffer(b"".join(pieces), np.uint8)
        self.n = n = len(data)
        self.starts = np.cumsum([0, *map(len, pieces)])
        first = np.unique(self.starts[:-1][np.diff(self.starts) > 0])
        symbol, after, before = ranks.single[data], np.arange(1, n + 1), np.arange(-1, n - 1)
        if n and symbol.min() < 0:
            raise ValueError("the rank file lacks a single byte")
        before[first] = -1
        after[np.append(first[1:], n)[:len(first)] - 1] = n
        stands = np.full(n, -1, np.int32)
        if n:
            stands[:-1] = ranks.byte_pairs[data[:-1], data[1:]]
            stands[after == n] = -1
        self.symbol, self.stands = array("i", symbol.astype(np.int32).tobytes()), array("i", stands.tobytes())
        self.after, self.before = array("q", after.tobytes()), array("q", before.tobytes())
        self.vectors = (np.frombuffer(self.symbol, np.int32), np.frombuffer(self.stands, np.int32),
                        np.frombuffer(self.after, np.int64), np.frombuffer(self.before, np.int64))
        self.index: dict[int, list[int]] = {}
        self.heap: list[int] = []
        self._add(stands, np.arange(n))

    def _add(self, made: np.ndarray, places: np.ndarray) -> None:
        """Enter places whose pairs make these tokens."""
        there = made >= 0
        made, places = made[there], places[there]
        order = np.argsort(made, kind="stable")
        made, places = made[order], places[order].tolist()
        cuts = np.flatnonzero(np.diff(made, prepend=-1)).tolist()
        for start, end in zip(cuts, [*cuts[1:], len(places)]):
            self._enter(int(made[start]), places[start:end])

    def _enter(self, made: int, places: list[int]) -> None:
        if (held := self.index.get(made)) is None:
            self.index[made] = places
            heapq.heappush(self.heap, made)
        else:
            held += places

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that these neighbours make."""
        keys, at = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        return np.array([self.pair(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], np.int32)[at]

    def run(self) -> list[bytes]:
        """Apply all merges, lowest rank first; the token numbers of each piece as 32-bit integers."""
        while self.heap:
            rank = heapq.heappop(self.heap)
            places = self.index.pop(rank)
            if len(places) < MANY or not self._at_once(rank, np.array(places)):
                self._in_turn(rank, sorted(places))
        symbol = self.vectors[0]
        left = symbol >= 0
        upto = np.concatenate([[0], np.cumsum(left)])[self.starts].tolist()
        flat = symbol[left].tobytes()
        return [flat[4 * a:4 * b] for a, b in zip(upto, upto[1:])]

    def _at_once(self, rank: int, places: np.ndarray) -> bool:
        """Apply one merge at all its places; False, with nothing done, if it makes a pair of lower rank."""
        symbol, stands, after, before = self.vectors
        i = np.sort(places[stands[places] == rank])
        if not len(i):
            return True
        j = after[i]
        touching = np.append(False, j[:-1] == i[1:])
        if touching.any():
            # a chain of equal symbols: from the left, every second place
            start = np.maximum.accumulate(np.where(touching, 0, np.arange(len(i))))
            i = i[(np.arange(len(i)) - start) % 2 == 0]
            j = after[i]
        k, h = after[j], before[i]
        to_right, to_left = k < self.n, h >= 0
        one = np.full(len(i), rank)
        old = np.concatenate([self._pairs(one[to_right], symbol[k[to_right]]), self._pairs(symbol[h[to_left]], one[to_left]), [self.pair(rank, rank)]])
        if ((old >= 0) & (old < rank)).any():
            return False
        symbol[i], symbol[j], stands[i], stands[j] = rank, -1, -1, -1
        after[i] = k
        before[k[to_right]] = i[to_right]
        h = before[i]
        # a new symbol's left neighbour may be one of the new symbols: its pair to the right is that one
        whole = np.concatenate([i[to_right], h[h >= 0]])
        whole = np.unique(whole)
        made = self._pairs(symbol[whole], symbol[after[whole]])
        stands[whole] = made
        self._add(made, whole)
        return True

    def _in_turn(self, rank: int, places: list[int]) -> None:
        """Apply one merge place by place. If it makes a pair of lower rank, the other places wait for that one."""
        symbol, stands, after, before, pair, n = self.symbol, self.stands, self.after, self.before, self.pair, self.n
        index, heap = self.index, self.heap
        for done, i in enumerate(places):
            if stands[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbol[i], symbol[j], stands[i], stands[j] = rank, -1, -1, -1
            lower = False
            if k < n:
                before[k] = i
                if (made := pair(rank, symbol[k])) >= 0:
                    stands[i] = made
                    lower = made < rank
                    if (held := index.get(made)) is None:
                        index[made] = [i]
                        heapq.heappush(heap, made)
                    else:
                        held.append(i)
            h = before[i]
            if h >= 0:
                made = stands[h] = pair(symbol[h], rank)
                if made >= 0:
                    lower = lower or made < rank
                    if (held := index.get(made)) is None:
                        index[made] = [h]
                        heapq.heappush(heap, made)
                    else:
                        held.append(h)
            if lower:
                if done + 1 < len(places):
                    self._enter(rank, places[done + 1:])
                break


def replay(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Token numbers of each piece, as 32-bit integers: all merges, lowest rank first, over all pieces at once.

    The lowest rank in the index is applied at all of its places from left to right, and only the pairs
    beside each new symbol change. Merges of different pieces do not touch each other, so each piece sees its
    own merges in the order of the ranks. A piece that is a token is that token, as the libraries of such rank
    files have it. Pieces are replayed in lots of some ``LOT`` bytes.
    """
    done, lot, size = [], [], 0
    for piece in pieces:
        lot.append(piece if piece not in ranks.number else b"")
        size += len(lot[-1])
        if size >= LOT:
            done += Replay(lot, ranks).run()
            lot, size = [], 0
    done += Replay(lot, ranks).run()
    return [ranks.number[p].to_bytes(4, "little") if p in ranks.number else found for p, found in zip(pieces, done)]


class Encoder:
    """Encodes texts, remembering the pieces that come again."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(path)
        # white space as Unicode has it: \s of the regex library also takes four control characters
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token numbers of each text, as 32-bit integers. All pieces that are new in these texts are merged together."""
        cut = [self.cut.findall(t) for t in texts]
        known = self.known
        if len(known) > KNOWN_PIECES:
            known.clear()
        fresh = list(set().union(*cut).difference(known))
        known.update(zip(fresh, replay([p.encode() for p in fresh], self.ranks)))
        result = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in fresh:
            if len(piece) > LONG_PIECE:
                del known[piece]
        return result


def _together(texts: Iterable[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(batches: Iterator[pa.Array], encoder: Encoder) -> Iterator[pa.Array]:
    for batch in batches:
        for texts in _together(t.as_py() for t in batch):
            found = encoder.encode(texts)
            ends = np.cumsum([0, *map(len, found)]) // 4
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _decoded(lists: pa.Array, ranks: Ranks) -> pa.Array:
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([ranks.decode(flat[a:b]) if ok else b"" for a, b, ok in zip(ends, ends[1:], valid)], pa.binary())


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token numbers of a text (array<int>), in order, without special tokens.

    ``path``: a rank file at the same place on every executor. ``pattern``: cuts a text into the pieces whose
    bytes are merged separately. Texts are whole, whatever their length; NULL and empty texts have no
    tokens. Equal texts have equal tokens, whatever stands beside them: pieces that many texts share are
    merged once per task. A column function: other columns, repeated rows and empty tables need no care.
    """
    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _encoded(batches, Encoder(path, pattern))

    return encoded(text)


def decode(self, numbers: np.ndarray) -> bytes:
        """The bytes of a list of token numbers."""
        if not len(numbers):
            return b""
        if numbers.min() < 0 or numbers.max() >= len(self.length) or not self.length[numbers].all():
            raise ValueError("a token number is not in the rank file")
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.bytes[at].tobytes()


class Replay:
    """Symbols of many pieces in one list, and the index from each pair of neighbours to its places.

    A pair is named by the token it makes. ``stands`` holds for each place the pair that begins there, or -1;
    an entry of the index is stale if ``stands`` says otherwise by now. The arrays are linked lists by place,
    seen both as plain arrays and, for merges with many places, as vectors.
    """

    def __init__(self, pieces: list[bytes], ranks: Ranks):
        self.pair, data = ranks.pair, np.frombuffer(b"".join(pieces), np.uint8)
        self.n = n = len(data)
        self.starts = np.cumsum([0, *map(len, pieces)])
        first = np.unique(self.starts[:-1][np.diff(self.starts) > 0])
        symbol, after, before = ranks.single[data], np.arange(1, n + 1), np.arange(-1, n - 1)
        if n and symbol.min() < 0:
            raise ValueError("the rank file lacks a single byte")
        before[first] = -1
        after[np.append(first[1:], n)[:len(first)] - 1] = n
        stands = np.full(n, -1, np.int32)
        if n:
            stands[:-1] = ranks.byte_pairs[data[:-1], data[1:]]
            stands[after == n] = -1
        self.symbol, self.stands = array("i", symbol.astype(np.int32).tobytes()), array("i", stands.tobytes())
        self.after, self.before = array("q", after.tobytes()), array("q", before.tobytes())
        self.vectors = (np.frombuffer(self.symbol, np.int32), np.frombuffer(self.stands, np.int32),
                        np.frombuffer(self.after, np.int64), np.frombuffer(self.before, np.int64))
        self.index: dict[int, list[int]] = {}
        self.heap: list[int] = []
        self._add(stands, np.arange(n))

    def _add(self, made: np.ndarray, places: np.ndarray) -> None:
        """Enter places whose pairs make these tokens."""
        there = made >= 0
        made, places = made[there], places[there]
        order = np.argsort(made, kind="stable")
        made, places = made[order], places[order].tolist()
        cuts = np.flatnonzero(np.diff(made, prepend=-1)).tolist()
        for start, end in zip(cuts, [*cuts[1:], len(places)]):
            self._enter(int(made[start]), places[start:end])

    def _enter(self, made: int, places: list[int]) -> None:
        if (held := self.index.get(made)) is None:
            self.index[made] = places
            heapq.heappush(self.heap, made)
        else:
            held += places

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that these neighbours make."""
        keys, at = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        return np.array([self.pair(k >> 32, k & 0xFFFFFFFF) for k in keys.tolist()], np.int32)[at]

    def run(self) -> list[bytes]:
        """Apply all merges, lowest rank first; the token numbers of each piece as 32-bit integers."""
        while self.heap:
            rank = heapq.heappop(self.heap)
            places = self.index.pop(rank)
            if len(places) < MANY or not self._at_once(rank, np.array(places)):
                self._in_turn(rank, sorted(places))
        symbol = self.vectors[0]
        left = symbol >= 0
        upto = np.concatenate([[0], np.cumsum(left)])[self.starts].tolist()
        flat = symbol[left].tobytes()
        return [flat[4 * a:4 * b] for a, b in zip(upto, upto[1:])]

    def _at_once(self, rank: int, places: np.ndarray) -> bool:
        """Apply one merge at all its places; False, with nothing done, if it makes a pair of lower rank."""
        symbol, stands, after, before = self.vectors
        i = np.sort(places[stands[places] == rank])
        if not len(i):
            return True
        j = after[i]
        touching = np.append(False, j[:-1] == i[1:])
        if touching.any():
            # a chain of equal symbols: from the left, every second place
            start = np.maximum.accumulate(np.where(touching, 0, np.arange(len(i))))
            i = i[(np.arange(len(i)) - start) % 2 == 0]
            j = after[i]
        k, h = after[j], before[i]
        to_right, to_left = k < self.n, h >= 0
        one = np.full(len(i), rank)
        old = np.concatenate([self._pairs(one[to_right], symbol[k[to_right]]), self._pairs(symbol[h[to_left]], one[to_left]), [self.pair(rank, rank)]])
        if ((old >= 0) & (old < rank)).any():
            return False
        symbol[i], symbol[j], stands[i], stands[j] = rank, -1, -1, -1
        after[i] = k
        before[k[to_right]] = i[to_right]
        h = before[i]
        # a new symbol's left neighbour may be one of the new symbols: its pair to the right is that one
        whole = np.concatenate([i[to_right], h[h >= 0]])
        whole = np.unique(whole)
        made = self._pairs(symbol[whole], symbol[after[whole]])
        stands[whole] = made
        self._add(made, whole)
        return True

    def _in_turn(self, rank: int, places: list[int]) -> None:
        """Apply one merge place by place. If it makes a pair of lower rank, the other places wait for that one."""
        symbol, stands, after, before, pair, n = self.symbol, self.stands, self.after, self.before, self.pair, self.n
        index, heap = self.index, self.heap
        for done, i in enumerate(places):
            if stands[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            symbol[i], symbol[j], stands[i], stands[j] = rank, -1, -1, -1
            lower = False
            if k < n:
                before[k] = i
                if (made := pair(rank, symbol[k])) >= 0:
                    stands[i] = made
                    lower = made < rank
                    if (held := index.get(made)) is None:
                        index[made] = [i]
                        heapq.heappush(heap, made)
                    else:
                        held.append(i)
            h = before[i]
            if h >= 0:
                made = stands[h] = pair(symbol[h], rank)
                if made >= 0:
                    lower = lower or made < rank
                    if (held := index.get(made)) is None:
                        index[made] = [h]
                        heapq.heappush(heap, made)
                    else:
                        held.append(h)
            if lower:
                if done + 1 < len(places):
                    self._enter(rank, places[done + 1:])
                break


def replay(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Token numbers of each piece, as 32-bit integers: all merges, lowest rank first, over all pieces at once.

    The lowest rank in the index is applied at all of its places from left to right, and only the pairs
    beside each new symbol change. Merges of different pieces do not touch each other, so each piece sees its
    own merges in the order of the ranks. A piece that is a token is that token, as the libraries of such rank
    files have it. Pieces are replayed in lots of some ``LOT`` bytes.
    """
    done, lot, size = [], [], 0
    for piece in pieces:
        lot.append(piece if piece not in ranks.number else b"")
        size += len(lot[-1])
        if size >= LOT:
            done += Replay(lot, ranks).run()
            lot, size = [], 0
    done += Replay(lot, ranks).run()
    return [ranks.number[p].to_bytes(4, "little") if p in ranks.number else found for p, found in zip(pieces, done)]


class Encoder:
    """Encodes texts, remembering the pieces that come again."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks(path)
        # white space as Unicode has it: \s of the regex library also takes four control characters
        self.cut = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token numbers of each text, as 32-bit integers. All pieces that are new in these texts are merged together."""
        cut = [self.cut.findall(t) for t in texts]
        known = self.known
        if len(known) > KNOWN_PIECES:
            known.clear()
        fresh = list(set().union(*cut).difference(known))
        known.update(zip(fresh, replay([p.encode() for p in fresh], self.ranks)))
        result = [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        for piece in fresh:
            if len(piece) > LONG_PIECE:
                del known[piece]
        return result


def _together(texts: Iterable[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(batches: Iterator[pa.Array], encoder: Encoder) -> Iterator[pa.Array]:
    for batch in batches:
        for texts in _together(t.as_py() for t in batch):
            found = encoder.encode(texts)
            ends = np.cumsum([0, *map(len, found)]) // 4
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _decoded(lists: pa.Array, ranks: Ranks) -> pa.Array:
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([ranks.decode(flat[a:b]) if ok else b"" for a, b, ok in zip(ends, ends[1:], valid)], pa.binary())


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token numbers of a text (array<int>), in order, without special tokens.

    ``path``: a rank file at the same place on every executor. ``pattern``: cuts a text into the pieces whose
    bytes are merged separately. Texts are whole, whatever their length; NULL and empty texts have no
    tokens. Equal texts have equal tokens, whatever stands beside them: pieces that many texts share are
    merged once per task. A column function: other columns, repeated rows and empty tables need no care.
    """
    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for texts in _together(t.as_py() for t in batch):
                found = encoder.encode(texts)
                ends = np.cumsum([0, *map(len, found)]) // 4
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))

    return encoded(text)


def decode(numbers: Column, path: str) -> Column:
    """The bytes (binary) of token numbers: what ``encode`` got, as UTF-8. NULL and empty lists give no bytes.

    A number that the rank file lacks is an error. Cutting a list between tokens may cut a character, so the
    result is bytes, not text. A column function, as ``encode``.
    """
    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = Ranks(path)
        for batch in batches:
            for start in range(0, len(batch), 200):
                yield _decoded(batch.slice(start, 200), ranks)

    return decoded(numbers)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """Struct of ``ids``, as ``encode`` gives them, and ``decoded``, what ``decode`` makes of these ids.

    Both steps run in one process of a task, which then holds the rank file once.
    """
    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path, pattern)
        for ids in _encoded(batches, encoder):
            yield pa.StructArray.from_arrays([ids, _decoded(ids, encoder.ranks)], ["ids", "decoded"])

    return both(text)
