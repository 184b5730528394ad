import hashlib
import random

import pytest
import sentencepiece

from casebook.llm.pieces import decoded, default_model, encoded, model_at
from tests.llm.conftest import AWKWARD


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text or "")
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")


def test_random_texts(library):
    random.seed(3)
    alphabet = " ▁aetnsE.,'é日\n\t🎉\x00́#1"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 80))) for _ in range(2000)]
    model = model_at(default_model())
    for text, parts in zip(texts, model.encode_batch(texts, True), strict=True):
        ids = library.encode(text)
        assert ",".join(p[1] for p in parts) == ",".join(map(str, ids))
        assert model.decoded(parts) == library.decode(ids).encode()


def test_awkward_rows(awkward, library):
    got = sorted(map(tuple, encoded(awkward).collect()), key=str)
    want = sorted(((r.doc_id, *expected(library, r.text)) for r in awkward.collect()), key=str)
    assert got == want


def test_documents(documents, library):
    got = {r.doc_id: tuple(r)[1:] for r in encoded(documents).collect()}
    assert got == {r.doc_id: expected(library, r.text) for r in documents.collect()}


def test_round_trip(table):
    rows = encoded(table(AWKWARD), keep_ids=True, keep_text=True)
    back = {r.doc_id: r.decoded for r in decoded(rows).collect()}
    for r in rows.collect():
        assert back[r.doc_id] == r.decoded == (AWKWARD[r.doc_id] or "").replace("▁", " ")
        assert len(r.ids) == r.n_tokens


def test_decode_of_broken_bytes(spark, library):
    ids = [library.piece_to_id(f"<0x{b:02X}>") for b in (0xE6, 0x41, 0xFF, 0xC3, 0xA9)]
    row = decoded(spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.decoded for r in row} == {1: library.decode(ids), 2: "", 3: ""}


def test_empty_table(table):
    assert encoded(table([])).count() == 0
