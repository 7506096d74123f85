"""Word splitting and 64-bit hashing shared by the operators that run numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_UPPER = bytes(range(65, 91))
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: As LOWER, and every ASCII byte that is not a letter or digit becomes a space.
ALNUM = bytes(b if b >= 0x80 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))

C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII whitespace: bytes.split() cuts at space and 0x09-0x0D, no more."""
    return text.translate(LOWER).split()


def split_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`space_words` of all texts, one after another, and how many each has; a null has none."""
    kind = pa.large_utf8() if pa.types.is_large_binary(texts.type) else pa.utf8()
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(kind)))  # bytes that are no ASCII are passed over
    words, counts = found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = words.view(pa.binary()) if kind == pa.utf8() else words.view(pa.large_binary()).cast(pa.binary())
    empty = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
    if len(empty):  # whitespace at the ends of a text leaves empty words
        ends = np.cumsum(counts)
        counts -= np.searchsorted(empty, ends) - np.searchsorted(empty, ends - counts)
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    return words, counts


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """One order-sensitive hash for each run of n consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out + h[i : i + m] + C1)
    return out


def blobs(array: pa.Array) -> list[bytes | None]:
    return array.to_pylist()


def longs(rows: np.ndarray) -> pa.Array:
    """A 2-D integer array as a list<int64> column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))
