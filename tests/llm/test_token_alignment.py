import hashlib
from collections import Counter

import numpy as np
import pytest

from casebook.llm import token_alignment
from casebook.llm.token_alignment import aligned, lockstep, loaded


@pytest.fixture(scope="module")
def libraries():
    """The two libraries on the files that the contract names."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """The byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


def tokens_of(libraries, text):
    a, b = libraries
    letters = byte_level()
    due = (" " + (text or "")).encode()
    if not text:
        return [], []
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in left) != due or b"".join(x for _, x in right) != due:
        return [], []
    return left, right


def groups_of(left, right):
    ends = lambda side: set(np.cumsum([len(x) for _, x in side]).tolist())
    cuts = sorted(ends(left) & ends(right))
    out = [([], []) for _ in cuts]
    for k, side in enumerate((left, right)):
        at = 0
        for i, x in side:
            at += len(x)
            out[next(g for g, c in enumerate(cuts) if c >= at)][k].append(i)
    return out


def brute(libraries, rows):
    docs = []
    for doc_id, text in rows:
        left, right = tokens_of(libraries, text)
        groups = groups_of(left, right)
        links = Counter((a, b) for x, y in groups for a in x for b in y)
        docs.append((doc_id, left, right, groups, links))
    counts = Counter(p for d in docs for p in d[4])
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc_id, left, right, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, len(left), len(right), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if left else "",
        ))
    return sorted(out, key=str)


TEXTS = [
    "Hello world, naïve façade 123456", "  two  spaces\n\n\ttabs", "<s> </s> <|endoftext|> <unk> <0x0A>", "日本語のテキスト🎉🎉", "▁ mark",
    "\x00 null", "don't can't I'll", "a" * 300, "é" * 50, " ", "\n", "Straße über größer", "مرحبا بالعالم", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢" * 20,
]


def test_against_the_libraries(table, libraries, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "", *TEXTS[:3]])]
    want = brute(libraries, rows)
    got = token_alignment.token_alignment(table([t for _, t in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert next(r for r in want if r[0] == 4)[1] == 0 and sum(r[1] > 0 for r in want) > 10


def test_documents_in_small_blocks(documents, libraries):
    docs = documents.where("n_chars < 900 and doc_id < 90")
    got = token_alignment.token_alignment(docs.repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(libraries, [(r.doc_id, r.text) for r in docs.collect()])


def test_large_groups_and_blocks(libraries, monkeypatch):
    """Groups over the limit are reduced by id and give the same pairs."""
    tokenizers = loaded(None, None)
    block = token_alignment.aligned_block(tokenizers, TEXTS)
    want = [x.tolist() for x in token_alignment.linked_pairs(block)]
    for limit in (0, 1, 3):
        monkeypatch.setattr(token_alignment, "LARGE_GROUP", limit)
        assert [x.tolist() for x in token_alignment.linked_pairs(block)] == want


def test_lockstep_against_common_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sides = [[], []]
        for _ in range(rng.integers(0, 6)):
            n = int(rng.integers(0, 40))
            for side in sides:
                side.append(sorted({*rng.integers(1, n, rng.integers(0, 20)).tolist(), n}) if n > 1 else [1] * (n > 0))
        of = [np.concatenate([[0], np.cumsum([len(d) for d in side])]).astype(np.int64) for side in sides]
        ends = [np.array([e for d in side for e in d], np.int64) for side in sides]
        a, b = lockstep(ends[0], ends[1], of[0], of[1])
        want = [(of[0][k] + x.index(e) + 1, of[1][k] + y.index(e) + 1) for k, (x, y) in enumerate(zip(*sides, strict=True)) for e in x if e in y]
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_awkward_rows_and_none(awkward, table, libraries):
    want = brute(libraries, [(r.doc_id, r.text if len(r.text or "") < 10_000 else "") for r in awkward.collect()])
    got = {tuple(r)[:5] for r in token_alignment.token_alignment(awkward).collect()}
    assert {r[:5] for r in want if r[1]} <= got
    assert token_alignment.token_alignment(awkward).count() == awkward.count()
    assert token_alignment.token_alignment(table([])).count() == 0


def test_long_texts(table):
    texts = [" " * 1_000_000, "x" * 300_000, "word 12 " * 60_000]
    for r in token_alignment.token_alignment(table(texts)).collect():
        assert r.n_a > 0 and r.n_groups > 0


def test_aligned(table, libraries):
    got = {r.doc_id: r for r in aligned(table(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        left, right = tokens_of(libraries, text)
        groups = groups_of(left, right)
        assert got[i].a == [t for t, _ in left] and got[i].b == [t for t, _ in right]
        assert got[i].a_ends == np.cumsum([len(x) for x, _ in groups]).tolist()
        assert got[i].b_ends == np.cumsum([len(y) for _, y in groups]).tolist()
        assert got[i].cuts[-1:] == ([len((" " + text).encode())] if left else [])
