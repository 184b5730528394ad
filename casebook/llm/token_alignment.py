"""Two tokenizers' tokens of the same text, aligned, with corpus counts of linked ids.

The documents of a batch are merged in lockstep: one vector of pointers into the ends
of A's tokens and one into B's advance by a comparison per document and step. Where
both tokens end at the same byte, the step emits a cut: a group is done, and its A and
B tokens are linked, all with all. Finished documents leave the vectors.

Counts of id pairs over the corpus: a block of documents (bounded in bytes of text)
names each of its pairs once, with the number of its documents that hold it. These
rows add up to the count table, meet it again by pair, and go back to their block,
whose documents hold places in the block's list of pairs. So a frequent pair is one
row of a block, never one of each document or occurrence.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.batches import slices
from casebook.session import written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bits of an id in a pair's number. Vocabularies are below a million ids.
ID_BITS = 20
#: A group with more links than this is reduced to distinct ids on either side before they are paired.
LARGE_GROUP = 1 << 12

ROWS = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, times binary, pairs array<long>, docs array<int>"
)
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ALIGNED = "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>, cuts array<long>"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """A, a byte-level vocabulary given as ranks (the same ids as its JSON form), and B, a piece vocabulary."""

    def __init__(self, ranks: str, model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json = os.path.splitext(ranks)[0] + ".json"
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.b.get_piece_size()
        if max(n, len(table)) >= 1 << ID_BITS:
            raise ValueError("too many ids for a pair's number")
        self.a_bytes = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.a_bytes[i] = token
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(n))
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_comma, self.a_bar = (np.array([f"{i}{c}" for i in range(len(self.a_bytes))], object) for c in ",|")
        self.b_comma, self.b_semicolon = (np.array([f"{i}{c}" for i in range(n)], object) for c in ",;")
        self._plain = None

    def a_ids(self, text: str) -> list[int]:
        try:
            return self.a.encode_ordinary(text)
        except BaseException as e:  # a panic of the library on one endless stretch is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self._plain is None:
                from tokenizers import Tokenizer

                self._plain = Tokenizer.from_file(self.json)
                self._plain.encode_special_tokens = True
            return self._plain.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none if the text is empty or either side's bytes are not those of space and text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        spaced = " " + text
        due, a, b = spaced.encode(), self.a_ids(spaced), self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != due or b"".join([self.b_bytes[i] for i in b]) != due:
            return none
        return np.array(a, np.int64), np.array(b, np.int64)


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def loaded(ranks: str | None, model: str | None) -> Tokenizers:
    key = (ranks or default_ranks(), model or default_model())
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(*key)
    return _LOADED[key]


@dataclass
class Block:
    """Tokens of a batch of documents on end, and the groups that cuts make of them.

    Group g holds A tokens a_at[g] to a_at[g + 1] and B tokens b_at[g] to b_at[g + 1];
    document k has tokens a_of[k] to a_of[k + 1] and groups g_of[k] to g_of[k + 1].
    """

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    g_of: np.ndarray
    cuts: np.ndarray


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cut of every document how many tokens of A and of B lie before it, in order of documents.

    `a_ends` and `b_ends` are byte offsets within each document; its last ones are equal.
    """
    has = a_of[1:] > a_of[:-1]
    i, j, stop = a_of[:-1][has], b_of[:-1][has], a_of[1:][has]
    a_cuts, b_cuts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(i):
        x, y = a_ends[i], b_ends[j]
        up_a, up_b = x <= y, y <= x
        cut = up_a & up_b
        i, j = i + up_a, j + up_b
        if cut.any():
            a_cuts.append(i[cut])
            b_cuts.append(j[cut])
            # Only at a cut can a document end.
            going = i < stop
            if not going.all():
                i, j, stop = i[going], j[going], stop[going]
    a, b = np.concatenate(a_cuts), np.concatenate(b_cuts)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def aligned_block(tokenizers: Tokenizers, texts: list[str]) -> Block:
    both = [tokenizers.encode(t) for t in texts]
    a, b = (np.concatenate([x[k] for x in both]) if both else np.zeros(0, np.int64) for k in (0, 1))
    a_of, b_of = (np.concatenate([[0], np.cumsum([len(x[k]) for x in both], dtype=np.int64)]).astype(np.int64) for k in (0, 1))

    def ends(sizes: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(sizes)])
        return total[1:] - np.repeat(total[of[:-1]], np.diff(of))

    a_ends, b_ends = ends(tokenizers.a_sizes[a], a_of), ends(tokenizers.b_sizes[b], b_of)
    a_cut, b_cut = lockstep(a_ends, b_ends, a_of, b_of)
    zero = np.zeros(1, np.int64)
    return Block(
        a, b, a_of, b_of, np.concatenate([zero, a_cut]), np.concatenate([zero, b_cut]),
        np.searchsorted(a_cut, a_of, side="right"), a_ends[a_cut - 1],
    )


def linked_pairs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of all links: distinct in each document, by document and pair."""
    x, y = np.diff(block.a_at), np.diff(block.b_at)
    doc = np.repeat(np.arange(len(block.g_of) - 1), np.diff(block.g_of))
    small = np.flatnonzero(x * y <= LARGE_GROUP)
    n = (x * y)[small]
    group = np.repeat(small, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = y[group]
    codes = (block.a[block.a_at[group] + k // wide] << ID_BITS) | block.b[block.b_at[group] + k % wide]
    docs, keys, times = [doc[group]], [codes], [np.ones(len(codes), np.int64)]
    for g in np.flatnonzero(x * y > LARGE_GROUP):
        a, na = np.unique(block.a[block.a_at[g] : block.a_at[g + 1]], return_counts=True)
        b, nb = np.unique(block.b[block.b_at[g] : block.b_at[g + 1]], return_counts=True)
        docs.append(np.full(len(a) * len(b), doc[g]))
        keys.append(((a[:, None] << ID_BITS) | b[None, :]).ravel())
        times.append((na[:, None] * nb[None, :]).ravel())
    d, c, t = np.concatenate(docs), np.concatenate(keys), np.concatenate(times)
    order = np.lexsort((c, d)) if len(docs) > 1 else np.argsort((d << (2 * ID_BITS)) | c, kind="stable")
    d, c, t = d[order], c[order], t[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[first], c[first], np.add.reduceat(t, first) if len(first) else t


def written_out(tokenizers: Tokenizers, block: Block, k: int) -> str:
    """A document's groups as a1,a2|b1;a3|b2,b3."""
    g0, g1 = block.g_of[k], block.g_of[k + 1]
    a0, a1, b0, b1 = block.a_of[k], block.a_of[k + 1], block.b_of[k], block.b_of[k + 1]
    a_end, b_end = block.a_at[g0 + 1 : g1 + 1] - a0, block.b_at[g0 + 1 : g1 + 1] - b0
    x, y = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
    out = np.empty(a1 - a0 + b1 - b0, object)
    # A's tokens stand behind the B tokens of earlier groups, B's behind the A tokens up to their group.
    a, b = block.a[a0:a1], block.b[b0:b1]
    a_place, b_place = np.arange(len(a)) + np.repeat(b_end - y, x), np.arange(len(b)) + np.repeat(a_end, y)
    out[a_place] = tokenizers.a_comma[a]
    out[b_place] = tokenizers.b_comma[b]
    out[a_place[a_end - 1]] = tokenizers.a_bar[a[a_end - 1]]
    out[b_place[b_end - 1]] = tokenizers.b_semicolon[b[b_end - 1]]
    return "".join(out.tolist())[:-1]


def _block_rows(tokenizers: Tokenizers, number: int, part: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each document, and one with the block's distinct pairs."""
    block = aligned_block(tokenizers, [t or "" for t in part.column("text").to_pylist()])
    n = part.num_rows
    doc, pair, times = linked_pairs(block)
    pairs, place, holders = np.unique(pair, return_inverse=True, return_counts=True)
    of = np.searchsorted(doc, np.arange(n + 1))
    place, times = place.astype("<i4"), times.astype("<i8")
    x = np.diff(block.a_at) * np.diff(block.b_at)
    links = np.concatenate([[0], np.cumsum(x)])[block.g_of]
    counts = [np.diff(block.a_of), np.diff(block.b_of), np.diff(block.g_of), np.diff(links)]
    digests = [
        hashlib.sha256(written_out(tokenizers, block, k).encode()).hexdigest() if block.a_of[k] < block.a_of[k + 1] else ""
        for k in range(n)
    ]
    narrow = lambda t: t.astype(np.uint8) if t.max(initial=0) < 256 else t
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number), pa.int64()),
            pa.array([*part.column("doc_id").to_pylist(), None], pa.int64()),
            *(pa.array([*c.tolist(), None], pa.int64()) for c in counts),
            pa.array([*digests, None], pa.string()),
            pa.array([*(place[of[k] : of[k + 1]].tobytes() for k in range(n)), None], pa.binary()),
            pa.array([*(narrow(times[of[k] : of[k + 1]]).tobytes() for k in range(n)), None], pa.binary()),
            pa.array([*[None] * n, pairs.tolist()], pa.list_(pa.int64())),
            pa.array([*[None] * n, holders.tolist()], pa.list_(pa.int32())),
        ],
        names=[c.split()[0] for c in ROWS.split(", ")],
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def aligned(docs: DataFrame, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """(doc_id, a, b, a_ends, b_ends, cuts): ids of both sides, and for each group how many tokens of
    either side, and how many bytes of space and text, lie before its end. Without tokens all are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = loaded(ranks, model)
        for batch in batches:
            for part in slices(batch, "text"):
                block = aligned_block(tokenizers, [t or "" for t in part.column("text").to_pylist()])
                rows = range(part.num_rows)
                groups = [slice(block.g_of[k], block.g_of[k + 1]) for k in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([block.a[block.a_of[k] : block.a_of[k + 1]] for k in rows], pa.list_(pa.int32())),
                        pa.array([block.b[block.b_of[k] : block.b_of[k + 1]] for k in rows], pa.list_(pa.int32())),
                        pa.array([block.a_at[1:][g] - block.a_of[k] for k, g in enumerate(groups)], pa.list_(pa.int32())),
                        pa.array([block.b_at[1:][g] - block.b_of[k] for k, g in enumerate(groups)], pa.list_(pa.int32())),
                        pa.array([block.cuts[g] for g in groups], pa.list_(pa.int64())),
                    ],
                    names=[c.split()[0] for c in ALIGNED.split(", ")],
                )

    return _texts(docs).mapInArrow(run, ALIGNED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, n): in how many documents each id pair is linked."""
    each = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    return (
        each.groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.docs").alias("n"))
        .withColumn("a", F.shiftright("pair", ID_BITS).cast("int"))
    )


def token_alignment(docs: DataFrame, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): tokens, groups and links, and what the corpus counts say of the links.

    Null and empty texts, and those that a side does not give back byte by byte, have
    no tokens: zeros and an empty digest. Every row is a document of its own, so
    repeated rows count; a null doc_id passes through; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = loaded(ranks, model)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                yield _block_rows(tokenizers, number, part)
                number += 1

    # Written, as block numbers must be the same wherever they are read.
    blocks = written(_texts(docs).mapInArrow(run, ROWS), "blocks")
    counts = written(pair_counts(blocks), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    marked = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(marked, "pair").select(F.col("block").alias("of_block"), "place", "n", "best")

    def scored(key: object, own: pa.Table, counts: pa.Table) -> pa.Table:
        size = counts.num_rows
        n, is_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = counts.column("place").to_numpy()
        n[place] = counts.column("n").to_numpy()
        is_best[place] = counts.column("best").to_numpy().astype(np.int64)
        sums, bests = [], []
        for p, t in zip(own.column("places").to_pylist(), own.column("times").to_pylist(), strict=True):
            p = np.frombuffer(p, "<i4")
            t = np.frombuffer(t, "<i8" if len(t) > len(p) else np.uint8).astype(np.int64)
            sums.append(int(n[p] @ t))
            bests.append(int(is_best[p] @ t))
        out = own.drop_columns(["block", "places", "times"])
        out = out.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))
        return out.select([c.split()[0] for c in SCHEMA.split(", ")])

    rows = blocks.where("pairs is null").drop("pairs", "docs")
    return rows.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(scored, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
