import random

import numpy as np
import pytest

from casebook.operators import keywords as K

SCHEMA, WORDS = "id bigint, question string, found__x string", "place bigint, keyword string"


def plain(text, words):
    least = {}
    for place, word in words:
        if word and place is not None:
            least[word] = min(place, least.get(word, place))
    return sorted((place, word) for word, place in least.items() if text is not None and word in text.lower())


@pytest.mark.parametrize("block", [K.BLOCK_BYTES, 40])
def test_equals_containment(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé🎉 ") for _ in range(n))
    words = [(i, word(rng.randint(1, 6))) for i in range(60)] + [(99, "ab"), (98, "ab"), (1, None), (None, "a"), (2, "")]
    texts = [word(rng.randint(0, 60)).upper() for _ in range(200)] + [None, "", "a", "AB"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    table = spark.createDataFrame(words, WORDS)
    rows = K.match_keywords(df, table).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [tuple(f) for f in r.found] == plain(r.question, words) and r.found__x == "x"


def test_long_texts_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(K, "STRETCH", 7)
    lookup = K.Lookup([(1, "needle"), (2, "zz"), (3, "q"), (4, "absent"), (5, "a needle longer than a stretch")])
    for shift in range(9):
        assert lookup.found("." * shift + "needle" + "." * 8 + "zz" + "." * 5 + "q") == [0, 1, 2]
        assert lookup.found("." * shift + "a needle longer than a stretch") == [0, 4]


def test_many_keywords_of_one_beginning():
    many = [(i, f"prefix{i}") for i in range(5000)]
    lookup = K.Lookup(many)
    assert lookup.found("lorem " * 200_000 + "prefix4999") == [i for i, word in many if word in "prefix4999"]


def test_equal_hashes_are_checked(monkeypatch):
    monkeypatch.setattr(K, "MIX", np.uint64(0))  # all keywords of one length meet
    lookup = K.Lookup([(i, word) for i, word in enumerate(["abc", "xbc", "ab", "bc"])])
    assert lookup.found("zabcz") == [0, 2, 3]


def test_no_keywords_no_texts_and_no_shuffle_of_texts(spark):
    df = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    assert K.match_keywords(df, spark.createDataFrame([], WORDS)).first().found == []
    table = spark.createDataFrame([(1, "a b")], WORDS)
    assert K.match_keywords(df.where("false"), table).count() == 0
    plan = K.match_keywords(df, table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
