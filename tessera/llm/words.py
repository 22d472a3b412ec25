"""Words of whole texts as numpy arrays: places, 64-bit hashes and shingles, a slice of texts at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over all 64 (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
#: Bytes that part runs of letters and digits; bytes of other characters than ASCII don't.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
#: For a piece of 0 to 8 bytes, the bits that are its own.
_OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashes(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word, the sum of its mixed pieces of eight bytes.

    Each piece is mixed with its place before it is added; sums of bytes times powers would give some long words of two letters equal hashes.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    count = (size + 7) >> 3
    first = np.cumsum(count) - count
    place = np.arange(first[-1] + count[-1]) - np.repeat(first, count)
    at = np.repeat(start, count) + 8 * place
    piece = sliding_window_view(np.concatenate((letters, np.zeros(8, np.uint8))), 8)[at].view("<u8")[:, 0]
    piece &= _OWN[np.minimum(np.repeat(end, count) - at, 8)]
    mixed = mix(piece ^ mix(place.astype(np.uint64) + _VALUE[3]))
    return mix(np.add.reduceat(mixed, first) + mix(size.astype(np.uint64) + _VALUE[7]))


@dataclass
class Words:
    """hashes of the words of all texts in turn; text i has words first[i] to first[i + 1]; start and end are their bytes in data."""

    data: bytes
    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def strings(self, i: int) -> list[bytes]:
        a, b = self.first[i], self.first[i + 1]
        return [self.data[x:y] for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]

    def coded(self, chosen: np.ndarray | slice = slice(None), lower: bool = False) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of the chosen words, and the word of each number: equal words have equal numbers, others others."""
        start, sizes = self.start[chosen], self.end[chosen] - self.start[chosen]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        letters = np.frombuffer(self.data, np.uint8)[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)]
        letters = _LOWER[letters] if lower else letters
        found = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def words_of(texts: list[str | None], lower: bool = False, separators: np.ndarray = _SEPARATOR) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text (null: none), or those between other separators; with lower, A-Z count as a-z."""
    coded = [x.encode() if x else b"" for x in texts]
    data = b"\n" + b"\n".join(coded) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    apart = separators[raw]
    start = np.flatnonzero(apart[:-1] & ~apart[1:]) + 1
    end = np.flatnonzero(~apart[:-1] & apart[1:]) + 1
    offsets = np.cumsum([1, *(len(x) + 1 for x in coded)])
    first = np.searchsorted(start, offsets)
    hashes = _hashes(_LOWER[raw] if lower else raw, start, end)
    return Words(data, hashes, first, start, end)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; entry i starts at word i, and there are n - 1 fewer than words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : k + len(out)] * _VALUE[2 * k + 11] if k else hashes[: len(out)] * _VALUE[11]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of every text; a shorter text's whole sequence is its one shingle, no words give none."""
    every = shingles(words.hashes, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            out.append(mix(shingles(words.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
