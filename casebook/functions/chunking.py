"""Overlapping chunks of a text.

A text is one row, so the whole rule runs inside that row: no shuffle, and a
table of any size is chunked by independent tasks, on Arrow batches of texts.

The text is cut into pieces at blank lines. Runs of pieces shorter than the chunk
size are merged into chunks; a longer piece is cut at the next separator (line
break, space) and, if nothing else is left, into overlapping windows.

Merging works on the pieces' end positions, so a text takes time in proportion to
its length. (As nested array functions the same rule copies the list of pieces for
every chunk, which is quadratic.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from casebook.functions.text import STRIP_CHARS

SEPARATORS = ["\n\n", "\n", " "]
# Text that a task holds as Python strings at a time.
SLICE_BYTES = 1 << 20


def _windows(text: str, size: int, overlap: int) -> Iterator[str]:
    """Windows of ``size`` characters every ``size - overlap``; the first one that
    reaches the end is the last."""
    for start in range(0, max(1, len(text) - overlap), size - overlap):
        yield text[start : start + size]


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Chunks of a run of pieces that are all shorter than ``size``.

    A chunk takes as many pieces as fit. The next one starts with the longest tail
    of whole pieces that is at most ``overlap`` long and leaves room for the piece
    that did not fit.
    """
    ends = [0, *accumulate(map(len, pieces))]
    first = last = 0
    while last < len(pieces):
        while last < len(pieces) and ends[last + 1] - ends[first] <= size:
            last += 1
        yield "".join(pieces[first:last])
        if last < len(pieces):
            least = max(ends[last] - overlap, ends[last + 1] - size)
            while ends[first] < least:
                first += 1


def _chunks(text: str, level: int, size: int, overlap: int) -> Iterator[str]:
    """Chunks, not yet stripped, of a text that is cut at ``level``."""
    if level == len(SEPARATORS):
        yield from _windows(text, size, overlap)
        return
    # Cut before each leftmost, non-overlapping separator.
    separator = SEPARATORS[level]
    head, *rest = text.split(separator)
    run: list[str] = []
    for piece in [head, *(separator + part for part in rest)]:
        if len(piece) < size:
            if piece:
                run.append(piece)
            continue
        yield from _merged(run, size, overlap)
        run = []
        yield from _chunks(piece, level + 1, size, overlap)
    yield from _merged(run, size, overlap)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of a batch of ``SLICE_BYTES`` each, and at most one longer text."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0).to_numpy()
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    edges = [0, *cuts.tolist(), len(texts)]
    yield from (texts.slice(lo, hi - lo) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi > lo)


def _of_texts(cut: Callable[[str], Iterator[str]]) -> Callable[[Column], Column]:
    """A column function that strips the chunks of a text and drops what is empty; null stays null."""

    def of_slice(texts: pa.Array) -> pa.Array:
        kept = [
            None if text is None else [s for c in cut(text) if (s := c.strip(STRIP_CHARS))]
            for text in texts.to_pylist()
        ]
        return pa.array(kept, pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def chunks(texts: pa.Array) -> pa.Array:
        done = [of_slice(part) for part in _slices(texts)]
        return pa.concat_arrays(done) if done else of_slice(texts)

    return chunks


def fixed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string>: stripped, non-empty windows."""
    return _of_texts(lambda t: _windows(t, size, overlap))(text)


def recursive_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string>: chunks of at most ``size`` characters, in text order."""
    return _of_texts(lambda t: _chunks(t, 0, size, overlap))(text)
