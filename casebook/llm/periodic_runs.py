"""Runs of periodic words, found by exact integer convolutions over blocks.

At each scale B (1, 2, 4, ...) a text is cut into blocks of B words. The sum of
squared differences between a block and its shifted copies in the words that follow is
a convolution; a number-theoretic transform gives it exactly modulo a prime, for many
blocks at once. Where it is zero the block occurs again, and the distance (B to 2B - 1)
is a seed: the stretch over which words that far apart are equal is extended both ways,
and kept if it is long enough for its period. A run of period q holds, at the scale
with B <= q < 2B, a whole block whose copy at distance q is in the run too, so every
run of exponent 3 or more has a seed; a zero modulo the prime alone is refuted when the
run is compared word by word.

Not transformed are blocks that cannot add a run: those with a word that does not
recur within 2B words, and those that lie with all their copies in a run already found
(whose period is at most B: other distances there are its multiples).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casebook.llm.batches import slices

#: Fixed values of the transform: a prime of 31 bits, 15 * 2 ** 27 + 1, and a generator of its units.
PRIME, GENERATOR = 2013265921, 31
#: Numbers transformed at once.
BATCH = 1 << 18
#: Least length of a run, in words and in periods.
MIN_WORDS, MIN_PERIODS = 6, 4

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


@lru_cache(maxsize=64)
def _roots(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of a root of unity of order n."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(1, np.uint64)
    while len(out) < n // 2:
        step = np.uint64(pow(root, len(out), PRIME))
        out = np.concatenate([out, out * step % PRIME])
    return out[: max(n // 2, 1)]


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), modulo PRIME, in natural order.

    The inverse is left without its division by the length.
    """
    rows, n = x.shape
    p = np.uint64(PRIME)
    x = x.reshape(rows, n, 1)
    # Decimation in time with self-sorting: halves are combined, and the finished axis grows.
    size = 1
    while size < n:
        half = x.shape[1] // 2
        even, odd = x[:, :half], x[:, half:]
        w = _roots(2 * size, inverse)
        odd = odd * w % p
        x = np.concatenate([(even + odd) % p, (even + (p - odd)) % p], axis=2)
        size *= 2
    return x.reshape(rows, n)


def mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo PRIME, of each row's block with each place of its window.

    `blocks` is (m, B), `windows` (m, 3 B - 1); the result is (m, 2 B).
    """
    m, size = blocks.shape
    n = 4 * size
    p = np.uint64(PRIME)
    a = np.zeros((m, n), np.uint64)
    b = np.zeros((m, n), np.uint64)
    a[:, :size] = blocks[:, ::-1]
    b[:, : windows.shape[1]] = windows
    product = transform(transform(a) * transform(b) % p, inverse=True)
    cross = product[:, size - 1 : 3 * size - 1] * np.uint64(pow(n, -1, PRIME)) % p
    own = (blocks * blocks % p).sum(axis=1) % p
    sums = np.zeros((m, windows.shape[1] + 1), np.uint64)
    np.cumsum(windows * windows % p, axis=1, out=sums[:, 1:])
    theirs = (sums[:, size : size + 2 * size] - sums[:, : 2 * size]) % p
    return (own[:, None] + theirs + np.uint64(2) * (p - cross)) % p


class _Equal:
    """How far words d apart stay equal, for many seeds at once, by hashes of prefixes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids, self.n = ids, n
        base = np.uint64(0x9E3779B97F4A7C15)
        self.up = np.ones(n + 1, np.uint64)
        if n:
            self.up[1:] = base
        self.up = np.multiply.accumulate(self.up)
        codes = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        codes ^= codes >> np.uint64(29)
        codes = codes * np.uint64(0x94D049BB133111EB) * self.up[:n]
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)])

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from i on equal those from j on (i < j), but for chance."""
        a = self.total[i + length] - self.total[i]
        b = self.total[j + length] - self.total[j]
        return a * self.up[j - i] == b

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), self.n - j
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(i, j, middle) & open_
            low, high = np.where(good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), i.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(i - middle, j - middle, middle) & open_
            low, high = np.where(good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low

    def exact(self, start: int, end: int, d: int) -> bool:
        """Whether the stretch has period d and ends where it says, word by word."""
        ids = self.ids
        if (start and ids[start - 1] == ids[start - 1 + d]) or (end < self.n and ids[end] == ids[end - d]):
            return False
        return np.array_equal(ids[start : end - d], ids[start + d : end])

    def walked(self, i: int, d: int) -> tuple[int, int]:
        """The stretch around i with words d apart equal, found without hashes."""
        same = self.ids[:-d] == self.ids[d:]
        off = np.flatnonzero(~same)
        k = int(np.searchsorted(off, i))
        start = int(off[k - 1]) + 1 if k else 0
        if k < len(off) and off[k] == i:
            return i, i + d
        return start, (int(off[k]) if k < len(off) else len(same)) + d


def _recurs(ids: np.ndarray) -> np.ndarray:
    """How many words on each word occurs next; beyond the end where it does not."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    out = np.full(n, 2 * n + 2, np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def runs(ids: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, smallest period) of a sequence of small whole numbers, by start and period.

    A run is at least `min_words` and `min_periods` (3 or more) periods long.
    """
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods may hold no block with its copy")
    n = len(ids)
    found: list[tuple[int, int, int]] = []
    if n < max(min_words, min_periods):
        return found
    longest = _recurs(ids)  # of each block, the largest distance to a next occurrence
    if not (longest <= n // min_periods).any():
        return found
    wide = ids.astype(np.uint64)
    known: set[tuple[int, int]] = set()
    equal: _Equal | None = None
    covered = np.zeros(n, np.int64)  # the end of the furthest run found so far that covers a place
    size = 1
    while size <= n // min_periods:
        # Blocks whose words all recur in time, and whose copies do not all lie in one known run.
        starts = np.flatnonzero(longest < 2 * size) * size
        if len(starts):
            starts = starts[covered[starts] < np.minimum(starts + 3 * size - 1, n)]
        if len(starts):
            at, far = _seeds(wide, starts, size)
            inside = covered[at] >= at + far + size
            at, far = at[~inside], far[~inside]
            if len(at):
                equal = equal or _Equal(ids)
                new = _extended(equal, at, far, known, min_words, min_periods)
                found += new
                for start, length, _ in new:
                    np.maximum(covered[start : start + length], start + length, out=covered[start : start + length])
        pairs = len(longest) // 2
        longest = np.maximum(longest[0 : 2 * pairs : 2], longest[1 : 2 * pairs : 2])
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _seeds(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a block, distance of a copy) for all copies at distances from `size` to 2 `size` - 1."""
    n, at, far = len(ids), [], []
    rows = max(1, BATCH // (4 * size))
    for k in range(0, len(starts), rows):
        part = starts[k : k + rows]
        places = part[:, None] + np.arange(size, 4 * size - 1)[None, :]
        windows = np.where(places < n, ids[np.minimum(places, n - 1)], 0)
        blocks = ids[part[:, None] + np.arange(size)[None, :]]
        hit, d = np.nonzero(mismatch(blocks, windows)[:, :size] == 0)
        d = d + size
        fits = part[hit] + d + size <= n
        at.append(part[hit][fits])
        far.append(d[fits])
    return np.concatenate(at), np.concatenate(far)


def _extended(
    equal: _Equal, at: np.ndarray, far: np.ndarray, known: set[tuple[int, int]], min_words: int, min_periods: int
) -> list[tuple[int, int, int]]:
    """The runs around seeds whose smallest period is the distance; `known` has the ends of all runs so far."""
    start = at - equal.behind(at, at + far)
    end = at + far + equal.ahead(at, at + far)
    long_ = end - start >= np.maximum(min_words, min_periods * far)
    seeds = np.unique(np.stack([far[long_], start[long_], end[long_], at[long_]], axis=1), axis=0)
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, a, b, place in seeds.tolist():
        if (d, a) in out:
            continue
        if not equal.exact(a, b, d):
            a, b = equal.walked(place, d)
            if b - a < max(min_words, min_periods * d):
                continue
        # A stretch with a smaller period is the run of that period, which is known by now.
        if (a, b) not in known:
            known.add((a, b))
            out[d, a] = (a, b - a, d)
    return list(out.values())


def repeated(n: int, doc_id: int | None) -> np.ndarray | None:
    """The stated repetition of a tenth of all documents: for each place the original word's place; None for the others."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run keeps its first period."""
    out = np.ones(n, bool)
    for start, length, period in found:
        out[start + period : start + length] = False
    return out


def periodic_runs(docs: DataFrame, *, stated_repetition: bool = False, keep_runs: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): number of runs, the longest one, digests of all runs and of the rest.

    Words are runs of all but ASCII white space. `stated_repetition` first repeats a
    part of the words of those documents whose id says so; a null id says nothing.
    `keep_runs` adds the runs themselves and the collapsed text. A null or empty text
    has no words and no runs; the longest run is null then. Repeated rows and null
    ids pass through; other columns are left out.
    """
    schema = SCHEMA + (", " + RUNS if keep_runs else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [
                        _row(i, t or "", stated_repetition, keep_runs)
                        for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def _row(doc_id: int | None, text: str, stated_repetition: bool, keep_runs: bool) -> dict:
    words = text.encode().split()
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
    place = repeated(len(words), doc_id) if stated_repetition else None
    if place is not None:
        ids = ids[place]
        words = [words[i] for i in place.tolist()]
    found = runs(ids)
    if found:
        words = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]
    rest = b" ".join(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = {
        "doc_id": doc_id,
        "n_words": len(ids),
        "n_runs": len(found),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(rest).hexdigest(),
    }
    if keep_runs:
        row["runs"] = [{"start": s, "length": m, "period": q} for s, m, q in found]
        row["collapsed"] = rest.decode()
    return row


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), stated_repetition=True)
