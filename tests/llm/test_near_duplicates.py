import random
import re

import pytest

from casebook.llm.components import components
from casebook.llm.near_duplicates import MISS, deduplicated, fewest_matches, near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(docs):
    """docs: id -> text, ids distinct."""
    sets = {i: shingles(t) for i, t in docs.items()}
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in docs}


def check(df):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute({r.doc_id: r.text for r in df.select("doc_id", "text").collect()})


def test_documents(documents):
    check(documents)


@pytest.fixture
def family(table):
    """A base text in many versions, most of them close to it, some far from all, and copies."""
    random.seed(4)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(k % 16):
            words[random.randrange(len(words))] = f"v{random.randint(0, 10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 60 + [" ".join(base[:60] + [f"u{random.randint(0, 10**6)}" for _ in range(60)]) for _ in range(60)]
    random.shuffle(texts)
    return table(texts, first=100)


def test_family(family):
    check(family)


def test_awkward_rows(awkward):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert by_id[0] == {(0, 0, True)} and by_id[2] == {(0, 2, True)}
    assert by_id[3] == {(1, 3, True)} and by_id[4] == {(1, 4, True)}
    assert by_id[5] == {(1, 5, True)} and by_id[6] == by_id[11] == {(1, 5, False)}
    assert by_id[None] == {(0, None, True), (1, None, True)} or all(kept for _, _, kept in by_id[None])
    kept = deduplicated(awkward)
    assert kept.schema == awkward.schema
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 3, 4, 5, 5, 7, 8, 9, 10]


def test_one_id_with_two_texts(spark):
    rows = [(7, "a b c d e f"), (7, "k l m n o p"), (9, "a b c d e f"), (3, "k l m n o p"), (8, "z")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(7, 3), (9, 3), (3, 3), (8, 8)}


def test_empty_table(table):
    assert near_duplicates(table([])).count() == 0
    assert deduplicated(table([])).count() == 0


def test_thresholds():
    assert [fewest_matches(n) for n in (32, 96, 768)] == sorted(fewest_matches(n) for n in (32, 96, 768))
    assert fewest_matches(768) < 0.766 * 768 and MISS <= 1e-5


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}
