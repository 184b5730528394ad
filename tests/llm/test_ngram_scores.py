import math
import re
from collections import Counter

from casebook.llm.ngram_scores import ngram_scores, pack, pack_counts, unpack, unpack_counts
import numpy as np
import pytest

import casebook.llm.ngram_scores as ngram_scores_module


def brute(texts, order):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    everywhere = sum((grams(d) for d in docs), Counter())
    total = sum(map(len, docs))
    out = []
    for d in docs:
        own = grams(d)
        count = lambda g: everywhere[g] - own[g]  # noqa: E731, B023

        def score(g, rest=total - len(d), count=count):
            if len(g) == 1:
                return math.log(max(count(g), 0.5)) - math.log(max(rest, 1))
            return math.log(count(g)) - math.log(count(g[:-1])) if count(g) > 0 else math.log(0.4) + score(g[1:])

        longest = [tuple(d[max(0, i - order + 1) : i + 1]) for i in range(len(d))]
        backed = sum(len(g) > 1 and count(g) <= 0 for g in longest)
        out.append((len(d), backed, sum(map(score, longest)) / max(len(d), 1)))
    return out


def check(df, order=3):
    rows = df.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), n, b, round(s, 4)) for r, (n, b, s) in zip(rows, brute([r.text for r in rows], order), strict=True))
    got = sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.score, 4)) for r in ngram_scores(df, order).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) <= 2e-4 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(awkward, order):
    check(awkward, order)


def test_many_blocks(table, monkeypatch):
    monkeypatch.setattr(ngram_scores_module, "BLOCK_BYTES", 200)
    texts = ["the cat sat on the mat", "a cat sat on the mat again", None, "on the mat the cat sat"] * 20 + ["the cat " * 100]
    check(table(texts).repartition(3))
    assert ngram_scores_module.in_blocks(table(texts)).count() > 5


def test_documents(documents):
    check(documents)


def test_one_document_and_none(table):
    check(table(["a b a b"]))
    assert ngram_scores(table([])).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 56, 1000).astype(np.uint64))
    assert (unpack(pack(x)) == x).all()
    assert (unpack(pack(x[:1])) == x[:1]).all()
    c = rng.integers(0, 1 << 33, 1000)
    assert (unpack_counts(pack_counts(c)) == c).all()
