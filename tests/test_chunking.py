import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.functions import chunking
from casebook.functions.chunking import fixed_chunks, recursive_chunks
from casebook.operators.indexing import chunk_documents
from casebook.plans import inputs

SIZE, OVERLAP = 1000, 200


def joined(run):
    text = "".join(run).strip()
    return [text] if text else []


def merge(pieces):
    run, out = [], []
    for piece in pieces:
        if run and len("".join(run)) + len(piece) > SIZE:
            out += joined(run)
            total = len("".join(run))
            while total > OVERLAP or (total + len(piece) > SIZE and total > 0):
                total -= len(run.pop(0))
        run.append(piece)
    return out + joined(run)


def sequential(text, separators=("\n\n", "\n", " ")):
    """The chunking rule, one text at a time."""
    if not separators:
        return merge(list(text))
    head, rest = separators[0], separators[1:]
    parts = text.split(head)
    pieces = [p for p in [parts[0], *(head + p for p in parts[1:])] if p]
    out, short = [], []
    for piece in pieces:
        if len(piece) < SIZE:
            short.append(piece)
            continue
        out += merge(short) + sequential(piece, rest)
        short = []
    return out + merge(short)


ODD = [
    "",
    " \n\t ",
    "\n\n\n",
    "a\n\n\nb",
    "x" * 5000,
    "x" * 999,
    "x" * 1000,
    "x" * 1001,
    " no-break ",
    "mark \u001e inside\n\n" * 200,
    ("é😀" * 300 + " ") * 7 + "\n\n\n\n" + "w " * 900 + "\n\n" + "z" * 1801 + " k",
    "\n\n" + "q" * 998 + "\n\n" + " " * 2500 + "\n\nend",
    "thuê nhà " * 400,
    "short\n" * 500 + "y" * 1200 + "\nafter\n\n" + "line " * 30,
]


def random_texts(n):
    rng = random.Random(5)
    for _ in range(n):
        words = [
            rng.choice("abcdé") * rng.choice([1, 3, 9, 40, 990, 1000, 1700] if rng.random() < 0.02 else [1, 3, 7])
            for _ in range(rng.randint(1, 900))
        ]
        yield "".join(w + rng.choice([" "] * 12 + ["\n"] * 2 + ["\n\n", "\n\n\n"]) for w in words)


def test_recursive_matches_sequential_rule(spark):
    texts = ODD + list(random_texts(40))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in df.select("i", recursive_chunks(F.col("text")).alias("c")).collect():
        assert list(row.c) == sequential(texts[row.i]), row.i


def test_recursive_on_whole_documents(spark):
    docs = inputs.documents(spark, "/root/testdata/sf0.001")
    for row in docs.select("text", recursive_chunks(F.col("text")).alias("c")).collect():
        assert list(row.c) == sequential(row.text)
        assert all(0 < len(c) <= SIZE and c == c.strip() for c in row.c)


def test_other_sizes(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(text,)], "text string")
    chunks = df.select(recursive_chunks(F.col("text"), 15, 5).alias("c")).first().c
    assert all(len(c) <= 15 for c in chunks)
    assert chunks[0] == "one two three" and chunks[-1].endswith("ten")


@pytest.mark.parametrize("length,count", [(1, 1), (1000, 1), (1001, 2), (1800, 2), (1801, 3)])
def test_fixed_windows(one, length, count):
    assert len(one(fixed_chunks(F.lit("x" * length)))) == count


def test_blank_line_cut(one):
    text = "a" * 999 + "\n\n\nb" + "c" * 998
    assert one(recursive_chunks(F.lit(text))) == ["a" * 999, "b" + "c" * 998]


def test_chunk_rows_keep_metadata(spark):
    df = spark.createDataFrame([(7, "u " * 900, "en", "s")], "doc_id bigint, text string, lang string, source string")
    rows = chunk_documents(df).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in rows] == [0, 1, 2]
    assert tuple(rows[1].chunk_id) == (7, 0, 1) and rows[1].lang == "en" and rows[1].source == "s"


def test_long_texts_take_proportional_time():
    """Counted in steps of the merge, not seconds: each piece is passed at most twice."""
    from casebook.functions.chunking import _chunks

    for size in (1 << 20, 1 << 22):
        text = ("word " * (size // 5))[:size]
        chunks = list(_chunks(text, 0, 1000, 200))
        assert len(chunks) == -(-(size - 200) // 800) or abs(len(chunks) - size / 800) < 5
        assert max(map(len, chunks)) <= 1000
    solid = list(_chunks("x" * (1 << 22), 0, 1000, 200))
    assert len(solid) == -(-((1 << 22) - 1000) // 800) + 1


def test_null_text(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id int, text string")
    assert {r.id: r.c for r in df.select("id", recursive_chunks(F.col("text")).alias("c")).collect()} == {1: None, 2: ["a"]}


def test_a_batch_is_cut_in_slices_of_bounded_size():
    texts = pa.array(["a" * 300_000, None, "", "é" * 900_000] * 8 + ["b" * 3_000_000])
    parts = list(chunking._slices(texts))
    assert pa.concat_arrays(parts).equals(texts)
    for part in parts:
        sizes = [len((x or "").encode()) for x in part.to_pylist()]
        assert sum(sizes) - max(sizes) < chunking.SLICE_BYTES
