"""Keyword tables too large for conditions in the plan.

A task hashes all runs of 1, 2, 4, 8, ... characters of a text, each length from the
one before. A keyword is known by the hashes of its first and its last run of the
largest such length that fits into it, which cover it whole; texts are asked for the
first hash, and where it occurs for both. Keywords go out in blocks of bounded size,
one pass over the texts each, so any number of them works, and no text is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from casebook.operators.ordering import spread

#: Odd numbers that hashes are multiplied by, modulo 2 ** 64.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
#: Bytes of keywords in one pass, and characters of a text looked at at once.
BLOCK_BYTES, STRETCH = 4 << 20, 1 << 20


def _hashes(text: str, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Run length and the hashes of all runs of that length, doubling up to `longest`."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    width, factor = 1, BASE
    while width <= min(longest, len(text)):
        yield width, h
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)


def _narrow(h: np.ndarray) -> np.ndarray:
    return (h * MIX) >> np.uint64(48)


class Lookup:
    """The keywords of a block, by length and hash."""

    def __init__(self, keywords: list[tuple[int, str]]):
        self.keywords = sorted(keywords)
        self.longest = max(len(word) for _, word in self.keywords)
        firsts: dict[int, list[np.uint64]] = defaultdict(list)
        keys: dict[int, dict[int, list[tuple[np.uint64, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, (_, word) in enumerate(self.keywords):
            *_, (width, h) = _hashes(word, len(word))
            firsts[width].append(h[0])
            keys[width][len(word)].append(((h[:1] * MIX + h[-1:])[0], number))
        self.levels = {}
        for width, hashes in firsts.items():
            first = np.unique(np.array(hashes, np.uint64))
            likely = np.zeros(1 << 16, bool)
            likely[_narrow(first)] = True
            lengths = []
            for length, pairs in keys[width].items():
                pairs.sort()
                hashes = np.array([k for k, _ in pairs], np.uint64)
                lengths.append((length, hashes, np.searchsorted(hashes, hashes, side="right"), [n for _, n in pairs]))
            self.levels[width] = (first, likely, lengths)

    def found(self, text: str) -> list[int]:
        """Numbers of the keywords that the text contains, by place."""
        hit: set[int] = set()
        for start in range(0, len(text), STRETCH):
            piece = text[start : start + STRETCH + self.longest - 1]
            for width, h in _hashes(piece, self.longest):
                if width not in self.levels:
                    continue
                first, likely, lengths = self.levels[width]
                at = np.flatnonzero(likely[_narrow(h)])
                at = at[first[np.searchsorted(first, h[at]).clip(max=len(first) - 1)] == h[at]]
                for length, keys, ends, numbers in lengths if len(at) else ():
                    q = at[at + length <= len(piece)]
                    both = h[q] * MIX + h[q + (length - width)]
                    place = np.searchsorted(keys, both).clip(max=len(keys) - 1)
                    same = keys[place] == both
                    met, where = np.unique(place[same], return_index=True)
                    for k, end, p in zip(met.tolist(), ends[met].tolist(), q[same][where].tolist(), strict=True):
                        for n in numbers[k:end]:  # equal hashes are no proof
                            word = self.keywords[n][1]
                            if piece.startswith(word, p) or word in text:
                                hit.add(n)
        return sorted(hit)


def match_keywords(df: DataFrame, keywords: DataFrame, text: str = "question", name: str = "found") -> DataFrame:
    """Add ``name``: array of (place, keyword) of all keywords that the text contains, by place.

    ``keywords(place, keyword)``; the smallest place is the first declared. The text is
    lowered first, the keywords are taken as they are. A repeated keyword counts at
    its smallest place; keywords that are null or empty or have no place match
    nothing. A null text has an empty array.
    """
    words = keywords.where("keyword <> '' and place is not null").groupBy("keyword").agg(F.min(F.col("place").cast("bigint")).alias("place"))
    size = words.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = spread(df).withColumn(name, F.array().cast("array<struct<place:bigint,keyword:string>>"))
    for block in range(blocks):
        rows = words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == block).collect()
        if rows:
            out = _with_block(out, [(r.place, r.keyword) for r in rows], text, name)
    return out.withColumn(name, F.array_sort(name)) if blocks > 1 else out


def _with_block(df: DataFrame, keywords: list[tuple[int, str]], text: str, name: str) -> DataFrame:
    """One pass: what the texts contain of these keywords is added to the array. The keywords are at most about a block."""
    shared = df.sparkSession.sparkContext.broadcast(keywords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        places = np.array([place for place, _ in lookup.keywords], np.int64)
        names = pa.array([word for _, word in lookup.keywords], pa.string())
        for batch in batches:
            lowered = batch.column(batch.num_columns - 1)
            numbers = [lookup.found(value.as_py()) if value.is_valid else [] for value in lowered]
            offsets = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int32)
            flat = np.array([n for row in numbers for n in row], np.int64)
            items = pa.StructArray.from_arrays([pa.array(places[flat]), names.take(pa.array(flat))], ["place", "keyword"])
            found = pa.ListArray.from_arrays(pa.array(offsets), items)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*batch.schema.names[:-1], new])

    new, lowered = f"{name}__block", f"{name}__lowered"
    schema = StructType([*df.schema.fields, StructField(new, df.schema[name].dataType)])
    passed = df.select("*", F.lower(F.col(text)).alias(lowered)).mapInArrow(run, schema)
    return passed.withColumn(name, F.concat(name, new)).drop(new)
