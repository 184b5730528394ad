"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score, then by
position, and merges the best one until no pair is in the vocabulary; what is
left outside the vocabulary becomes byte pieces. Where no piece of the
vocabulary joins two kinds of characters, no merge can cross from one to the
other, so a text is cut there (before a space mark, and between a Latin letter
and another kind of character, if the loaded vocabulary allows it) and stretches
that recur are encoded once. Each newly met stretch is compared with the
sentencepiece library in one call per Arrow batch; a difference ends the job.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casebook.llm.batches import slices

SPACE = "▁"

LETTER = "A-Za-z\u00c0-\u024f"
#: A run of space marks and what follows, up to the next one.
BY_SPACE = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: The same, but it ends with the first run of letters.
BY_LETTERS = re.compile(f"{SPACE}+[^{SPACE}{LETTER}]*[{LETTER}]*|[^{SPACE}{LETTER}]*[{LETTER}]+|[^{SPACE}{LETTER}]+")

#: Stretches kept by a Python worker, and the longest that is kept; beyond, they are encoded again.
KEPT = 1_000_000
KEPT_CHARS = 48
#: Up to this many characters the agenda is a plain list, beyond a heap.
SHORT = 24

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """A loaded vocabulary with its own encoder and decoder, and the library to check them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        self.byte_ids = {}
        self.pieces: dict[str, tuple[float, int]] = {}
        for i, name in enumerate(names):
            if self.library.is_byte(i):
                self.byte_ids[int(name[3:-1], 16)] = i
            elif self.library.is_control(i) or self.library.is_unknown(i):
                continue
            elif self.library.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            else:
                self.pieces[name] = (-self.library.get_score(i), i)  # the lowest comes first
        self.costs = {name: cost for name, (cost, _) in self.pieces.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary needs all 256 byte pieces")
        if any(SPACE in name.lstrip(SPACE) for name in self.pieces):
            raise ValueError("a piece has a space mark after another character")
        if self.library.encode(" a") == self.library.encode("a"):
            raise ValueError("vocabularies that drop white space are not supported")
        apart = re.compile(f"[{LETTER}][^{SPACE}{LETTER}]")
        self.stretch = BY_SPACE if any(apart.search(name) for name in self.pieces) else BY_LETTERS
        self.prefix = self.library.id_to_piece(self.library.encode("a")[0]).startswith(SPACE)
        if any("\n" in name for name in self.pieces):
            raise ValueError("vocabularies that merge line feeds are not supported")
        self.after_line = self.library.encode("\n")
        self.spoken = {i: p.replace(SPACE, " ").encode() for i, p in enumerate(names)}
        self.spoken |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, text: str) -> list[int]:
        """Ids of one stretch: the agenda of adjacent pairs, best score first, then leftmost."""
        return self._ids(self._merge_short(text) if len(text) <= SHORT else self._merge_long(text))

    def _merge_short(self, text: str) -> list[str | None]:
        """The agenda as a plain list of costs by place: for few symbols the least is found fastest so."""
        cost, symbols = self.costs.get, list(text)
        agenda = [cost(both, math.inf) for both in map(str.__add__, symbols, symbols[1:])]
        while agenda:
            least = min(agenda)
            if least == math.inf:
                break
            i = agenda.index(least)
            symbols[i] = both = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + both, math.inf)
            if i < len(agenda):
                agenda[i] = cost(both + symbols[i + 1], math.inf)
        return symbols

    def _merge_long(self, text: str) -> list[str | None]:
        """The agenda as a heap; pairs that a merge has outdated are skipped when they come up."""
        symbols: list[str | None] = list(text)
        pieces, n = self.pieces, len(symbols)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        agenda = [
            (pieces[both][0], i, i + 1, both)
            for i, both in enumerate(map(str.__add__, symbols, symbols[1:]))
            if both in pieces
        ]
        heapify(agenda)
        while agenda:
            _, i, j, both = heappop(agenda)
            if right[i] != j or symbols[i] is None or symbols[j] is None or symbols[i] + symbols[j] != both:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (new := both + symbols[k]) in pieces:
                    heappush(agenda, (pieces[new][0], i, k, new))
            h = left[i]
            if h >= 0 and (new := symbols[h] + both) in pieces:
                heappush(agenda, (pieces[new][0], h, i, new))
        return symbols

    def _ids(self, symbols: list[str | None]) -> list[int]:
        pieces, ids = self.pieces, []
        for symbol in symbols:
            if symbol is None:
                continue
            if symbol in pieces:
                ids.append(pieces[symbol][1])
            else:
                ids.extend([self.byte_ids[b] for b in symbol.encode()])
        return ids

    def decode_bytes(self, ids: list[int]) -> bytes:
        """Pieces as UTF-8 bytes, space marks as spaces; byte pieces stand for themselves."""
        spoken = self.spoken
        return b"".join([spoken[i] for i in ids])

    def check(self, stretches: list[str], ids: list[list[int]]) -> None:
        """Compare with the library.

        It adds the first space mark itself, though not to an empty text. A stretch
        without a mark is asked for behind a line feed, which merges with nothing.
        """
        asked, due = [], []
        for s, own in zip(stretches, ids, strict=True):
            if s == SPACE:
                continue
            if self.prefix and s[0] == SPACE:
                asked.append(s[1:].replace(SPACE, " "))
                due.append(own)
            else:
                asked.append("\n" + s.replace(SPACE, " "))
                due.append(self.after_line + own)
        for text, own, theirs in zip(asked, due, self.library.encode(asked, num_threads=1), strict=True):
            if own != theirs:
                raise ValueError(f"encoding differs from the library for {text[:80]!r}: {own[:20]} {theirs[:20]}")

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return self.stretch.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode_batch(self, texts: list[str], check: bool) -> Iterator[list[tuple[int, str, bytes]]]:
        """For each text its stretches as (number of ids, ids joined by commas, decoded bytes)."""
        if len(self.known) > KEPT:
            self.known.clear()
        known, cuts = self.known, [self.cut(t) for t in texts]
        fresh = [s for s in set().union(*cuts) if s not in known]
        ids = [self.merge(s) for s in fresh]
        if check and fresh:
            self.check(fresh, ids)
        local = {}
        for s, own in zip(fresh, ids, strict=True):
            entry = (len(own), ",".join(map(str, own)), self.decode_bytes(own))
            (known if len(s) <= KEPT_CHARS else local)[s] = entry
        for cut in cuts:
            yield [known[s] if s in known else local[s] for s in cut]

    def decoded(self, parts: list[tuple[int, str, bytes]]) -> bytes:
        """The decoded text; the space that stands for the added mark goes."""
        out = b"".join(p[2] for p in parts)
        return out[1:] if self.prefix and out.startswith(b" ") else out


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def default_model() -> str:
    """Where the public vocabulary lies; asked on each machine, as tasks open the file there."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(
    docs: DataFrame, model_path: str | None = None, *, check: bool = True, keep_ids: bool = False, keep_text: bool = False
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): number of ids, digests of ids and decoded text.

    `keep_ids` adds `ids` (array<int>), `keep_text` adds `decoded`. A null or empty
    text has no ids and decodes to the empty text. Repeated rows and null doc_ids
    pass through. `check` compares every newly met stretch with the library.
    """
    schema = SCHEMA + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path or default_model())
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n, a, b, lists, outs = [], [], [], [], []
                for parts in model.encode_batch(texts, check):
                    joined = ",".join([p[1] for p in parts])
                    out = model.decoded(parts)
                    n.append(sum([p[0] for p in parts]))
                    a.append(hashlib.sha256(joined.encode()).hexdigest())
                    b.append(hashlib.sha256(out).hexdigest())
                    if keep_ids:
                        lists.append([int(x) for x in joined.split(",")] if joined else [])
                    if keep_text:
                        outs.append(out.decode())
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                if keep_text:
                    columns.append(pa.array(outs, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def decoded(tokens: DataFrame, model_path: str | None = None) -> DataFrame:
    """Texts of (doc_id, ids array<int>) rows; null ids give the empty text.

    Byte pieces that form no valid UTF-8 become replacement characters, one for
    each byte, as in the library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(model_path or default_model())
        for batch in batches:
            texts = [replaced(out_of(model, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"]
            )

    def out_of(model: PieceModel, ids: list[int]) -> bytes:
        parts = [(0, "", model.decode_bytes(ids))]
        return model.decoded(parts)

    def replaced(data: bytes) -> str:
        try:
            return data.decode()
        except UnicodeDecodeError:
            out, i = [], 0
            while i < len(data):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(data[i : i + n].decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            return "".join(out)

    return tokens.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(
        run, "doc_id long, decoded string"
    )


def piece_counts(texts: list[str], model_path: str | None = None) -> list[int]:
    """Numbers of ids of a batch of texts, for use inside tasks."""
    model = model_at(model_path or default_model())
    return [sum([p[0] for p in parts]) for parts in model.encode_batch(texts, True)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
