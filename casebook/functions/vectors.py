"""Vector helpers: NumPy inside tasks, and feature hashing as a column expression.

A vector column is either ``array<float|double>`` or the sparse form
``struct<idx:array<int>, val:array<double>>``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.text import words

HASH_DIM = 1024
DIGITS = 6
# Words counted at once, and at most one longer text.
HASHED_WORDS = 1_000_000


def _hashed(words: pa.Array, dim: int) -> pa.Array:
    """Lists of words as unit vectors of their counts by bucket; a null list gives null buckets and weights."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    coded = words.flatten().dictionary_encode()
    # Each word of the batch is hashed once: the first 32 bits of its md5, as in ``text_bucket``.
    hashes = (hashlib.md5(w, usedforsecurity=False).digest()[:4] for w in coded.dictionary.cast(pa.binary()).to_pylist())
    bucket = np.fromiter((int.from_bytes(h, "big") % dim for h in hashes), np.int64, len(coded.dictionary))
    row = np.repeat(np.arange(len(words)), lengths)
    entry, count = np.unique(row * dim + bucket[coded.indices.to_numpy()], return_counts=True)
    row, count = entry // dim, count.astype(np.float64)
    norm = np.sqrt(np.bincount(row, count * count, len(words)))
    offsets = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
    fields = pa.array((entry % dim).astype(np.int32)), pa.array(count / norm[row])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, f, mask=words.is_null()) for f in fields], ["idx", "val"])


def hashed_vector(text: Column, dim: int = HASH_DIM) -> Column:
    """Unit-norm bag-of-words vector in sparse form; no words give empty arrays.

    Spark cuts the words, NumPy counts them on Arrow batches of texts.
    """

    @F.arrow_udf("struct<idx:array<int>,val:array<double>>")
    def hashed(batch: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // HASHED_WORDS)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        return pa.concat_arrays([_hashed(batch.slice(lo, hi - lo), dim) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])

    return hashed(words(text))


def arrow_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow vector column as a dense matrix, without a loop over its rows."""
    if pa.types.is_struct(column.type):
        idx, val = column.field("idx"), column.field("val")
        lengths = np.diff(idx.offsets.to_numpy())
        out = np.zeros((len(column), dim))
        out[np.repeat(np.arange(len(column)), lengths), idx.flatten().to_numpy()] = (
            val.flatten().to_numpy()
        )
        return out
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norm == 0, 1.0, norm)


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All squared Euclidean distances between two sets of rows."""
    total = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :]
    return np.maximum(total - 2.0 * (left @ right.T), 0.0)
