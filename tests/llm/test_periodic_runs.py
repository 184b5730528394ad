import hashlib
import random
import zlib

import numpy as np
import pytest

from casebook.llm.periodic_runs import MIN_PERIODS, MIN_WORDS, PRIME, _Equal, mismatch, periodic_runs, repeated, runs, transform


@pytest.fixture(autouse=True)
def wrapping():
    with np.errstate(over="ignore"):
        yield


def brute(ids):
    """All maximal runs, by comparing words for every period."""
    n, out = len(ids), []
    for q in range(1, n // MIN_PERIODS + 1):
        k = 0
        while k < n - q:
            e = k
            while e < n - q and ids[e] == ids[e + q]:
                e += 1
            length = e - k + q
            if e > k and length >= max(MIN_WORDS, MIN_PERIODS * q):
                if not any(all(ids[x] == ids[x + d] for x in range(k, k + length - d)) for d in range(1, q)):
                    out.append((k, length, q))
            k = max(e, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, stated):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if stated and n and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, n, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(0, PRIME, (3, 16)).astype(np.uint64)
    back = transform(transform(x), inverse=True).astype(object) * pow(16, -1, PRIME) % PRIME
    assert (back == x.astype(object)).all()
    for size in (1, 2, 8, 64):
        blocks = rng.integers(0, PRIME, (5, size)).astype(np.uint64)
        windows = rng.integers(0, PRIME, (5, 3 * size - 1)).astype(np.uint64)
        want = [
            [sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[r], windows[r, j : j + size], strict=True)) % PRIME for j in range(2 * size)]
            for r in range(5)
        ]
        assert mismatch(blocks, windows).tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n, v = rng.randrange(130), rng.choice([1, 2, 2, 3, 6])
        ids = [rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 10:
                a, p = rng.randrange(n), rng.randrange(1, 20)
                for i in range(a + p, min(n, a + p * rng.randrange(3, 8))):
                    ids[i] = ids[i - p]
        assert runs(np.array(ids, np.int32)) == brute(ids), ids


def test_large_and_hard_sequences():
    rng = np.random.default_rng(2)
    ones = np.zeros(300_000, np.int32)
    assert runs(ones) == [(0, 300_000, 1)]
    assert runs(np.concatenate([ones, [1], ones]).astype(np.int32)) == [(0, 300_000, 1), (300_001, 300_000, 1)]
    assert runs(np.tile(rng.permutation(7_000), 5).astype(np.int32)) == [(0, 35_000, 7_000)]
    # Words that cancel in 64-bit prefix hashes have no runs, and two cubes in a row are none of exponent 4.
    assert runs(np.array([bin(i).count("1") % 2 for i in range(1 << 14)], np.int32)) == []
    assert runs(np.tile([1, 1, 2], 3).astype(np.int32)) == []


def test_walk_without_hashes():
    ids = np.array([5, 1, 2, 1, 2, 1, 2, 1, 2, 9, 1, 2], np.int32)
    equal = _Equal(ids)
    assert equal.walked(3, 2) == (1, 9) and equal.exact(1, 9, 2)
    assert not equal.exact(2, 9, 2) and not equal.exact(1, 8, 2) and not equal.exact(0, 9, 2)


def test_documents(documents):
    rows = documents.where("n_chars < 1500").limit(60).collect()
    rows += documents.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 10) = 0 and n_chars < 4000").collect()
    ids = {r.doc_id for r in rows}
    got = {r.doc_id: tuple(r) for r in periodic_runs(documents, stated_repetition=True).collect() if r.doc_id in ids}
    assert got == {r.doc_id: brute_row(r.doc_id, r.text, True) for r in rows}
    assert any(r[2] for r in got.values())


def test_the_stated_repetition():
    hits = [i for i in range(300) if repeated(50, i) is not None]
    assert hits == [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert repeated(0, hits[0]) is None and repeated(50, None) is None


def test_awkward_rows_and_none(awkward, table):
    small = awkward.where("n_chars is null or n_chars < 1000")
    got = [tuple(r) for r in periodic_runs(small, stated_repetition=True).collect()]
    assert sorted(got, key=str) == sorted((brute_row(r.doc_id, r.text, True) for r in small.collect()), key=str)
    assert periodic_runs(awkward).count() == awkward.count()
    assert periodic_runs(table([])).count() == 0
    kept = periodic_runs(table(["x a b a b a b a b y", "word " * 30_000]), keep_runs=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in kept[0].runs] == [(1, 8, 2)] and kept[0].collapsed == "x a b y"
    assert (kept[1].length, kept[1].collapsed) == (30_000, "word")
