"""Token counts of a byte-level BPE vocabulary, without token numbers."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern by which byte-level BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: A task forgets its known pieces when there are this many, and never keeps pieces of more bytes.
KNOWN_PIECES, LONG_PIECE = 400_000, 64


def byte_symbols() -> dict[str, int]:
    """The printable sign that stands for each byte: its own where it is printable, else one from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """Merge ranks as a table of symbol pairs. Symbol 0 to 255 is a byte, 256 + r the result of merge r."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        symbols = dict(byte_symbols())
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[symbols[left] << 32 | symbols[right]] = rank
            symbols.setdefault(left + right, 256 + rank)
        special = [t["content"] for t in model.get("added_tokens", [])]
        # longest first, so that a string is not hidden by its own beginning
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """How many symbols are left when no pair of neighbours can be merged.

        The list of symbols is linked by index; the heap holds (rank, place) of neighbouring pairs. An entry
        is stale if the pair at its place has another rank by now.
        """
        ranks, n = self.ranks, len(piece)
        symbol, after, before = list(piece), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n or ranks.get(symbol[i] << 32 | symbol[j]) != rank:
                continue
            symbol[i], symbol[j] = 256 + rank, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(symbol[i] << 32 | symbol[k])) is not None:
                    heapq.heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := ranks.get(symbol[h] << 32 | symbol[i])) is not None:
                heapq.heappush(heap, (rank, h))
        return left

    def count_piece(self, piece: str) -> int:
        known = self.known.get(piece)
        if known is None:
            data = piece.encode()
            known = self.merged(data)
            if len(data) <= LONG_PIECE:
                if len(self.known) >= KNOWN_PIECES:
                    self.known.clear()
                self.known[piece] = known
        return known

    def count(self, text: str) -> int:
        """Tokens of a whole text. The added strings inside a text are one token each."""
        total, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            total += len(parts) - 1
        count = self.count_piece
        return total + sum(count(m) for part in parts for m in self.pieces.findall(part))


def count_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text (long).

    ``path``: a byte-level BPE file in the common JSON form, at the same place on every executor. The text
    is whole, whatever its length. NULL and empty texts have 0 tokens. A column function: other columns,
    repeated rows and empty tables need no care.
    """
    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = Merges(path)
        for batch in batches:
            yield pa.array([table.count(t.as_py() or "") for t in batch], pa.int64())

    return counted(text)
