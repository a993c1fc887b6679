"""Words of a text and their hashes, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd constants that spread the combination of two hashes over all bits.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A task forgets its known words when there are this many; they are then hashed anew.
KNOWN_WORDS = 400_000


def encoded(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; NULL is the empty text. One at a time: texts may be long."""
    for value in texts.cast(pa.large_binary()):
        yield value.as_py() or b""


def words(text: bytes) -> list[bytes]:
    """Words between white space (space, 0x09 to 0x0D), with A-Z as a-z."""
    return text.lower().split()


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words that come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        x = first * MIX_A + second * MIX_B
        return x ^ (x >> np.uint64(29))


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of the spread hash."""
    with np.errstate(over="ignore"):
        return ((hashes * MIX_A) >> np.uint64(64 - bits)).astype(np.int64)
