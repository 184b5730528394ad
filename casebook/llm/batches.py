"""Arrow batches of texts: bounded slices, and words with 64-bit hashes by NumPy.

Works on the UTF-8 bytes of a whole slice at once. All loops are over slices or
documents, never over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once. A longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Fixed values of the hashes: an odd base for bytes, one for words, one for mixing.
BYTE_BASE = np.uint64(0x9E3779B97F4A7C13)
WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about `budget` bytes in the named column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each text begins and ends; null is empty."""
    column = pc.fill_null(column, "")
    column = pa.concat_arrays([column.cast(pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i below n."""
    n = max(n, 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


_POWERS = powers(BYTE_BASE, 1)


def byte_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """`powers` of the byte base; kept for ordinary slices, made anew for a huge one."""
    global _POWERS
    if n > 4 * SLICE_BYTES:
        return powers(BYTE_BASE, n)
    if len(_POWERS[0]) < n:
        _POWERS = powers(BYTE_BASE, n)
    return _POWERS


@dataclass
class Words:
    """Words of a slice: hashes, byte ranges in `data` (lower case), and each text's range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def text(self, first: int, last: int) -> bytes:
        """Words first to last (exclusive) as bytes, joined by one space."""
        return b" ".join(
            self.data[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last], strict=True)
        )


def words(column: pa.Array, is_word: np.ndarray) -> Words:
    """Lower-case A-Z, then take the maximal runs of bytes that `is_word` (256 booleans) marks."""
    data, offsets = raw(column)
    data = ASCII_LOWER[data]
    n = len(data)
    inside = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = byte_powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each `length` consecutive words, wherever it begins."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, length):
        total = total * WORD_BASE + hashes[i : i + n]
    return mix(total)


#: Word bytes for shingles: everything but the ASCII white space 0x20 and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes for contamination windows, after lower-casing: digits, a to z, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
