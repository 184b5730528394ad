"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every text gives a row of statistics in one pass. Random Fourier features
approximate a Gaussian kernel on the standardised statistics; each partition sums
its part of the normal equations, the sums are added in a tree, and the driver
solves one system of `FEATURES` unknowns. For the calibration each labelled row gets
the score that the regression without this row gives it (which for ridge regression
follows from its leverage); these scores are binned (a count for each bin, so the
size is fixed) and made monotone by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.batches import raw, slices
from casebook.session import written

FEATURES = 160
RIDGE = 1.0
#: Width of the Gaussian kernel in standard deviations of the statistics.
WIDTH = 3.0
SEED = 11
BINS = 400
#: Sums of partitions that meet in one task.
FAN = 64
THRESHOLD = 0.7

_BYTES = np.arange(256)
_KINDS = np.stack(
    [
        ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122),  # Latin letters
        (_BYTES >= 65) & (_BYTES <= 90),  # capitals
        (_BYTES >= 48) & (_BYTES <= 57),  # digits
        _BYTES >= 128,  # beyond ASCII
        np.isin(_BYTES, list(b" \t\r\n\v\f")),  # white space
        _BYTES == 10,  # line ends
        np.isin(_BYTES, list(b".,;:'\"-()")),  # ordinary punctuation
        np.isin(_BYTES, list(b"!?")),  # emphasis
        np.isin(_BYTES, list(b"#$%&*@^~+=<>/\\_`")),  # symbols
        np.isin(_BYTES, list(b"|[]{}")),  # table and code marks
    ],
    axis=1,
).astype(np.float64)
STATISTICS = 21


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a whole text; all zero if it is empty."""
    n = len(text)
    if not n:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts[counts > 0] / n
    kinds = (counts @ _KINDS) / n
    words = text.split()
    distinct = set(words)
    n_words = max(len(words), 1)
    lines = [x for x in text.split(b"\n") if x]
    n_lines = max(len(lines), 1)
    return [
        np.log1p(n),
        *np.sqrt(kinds),
        float(-(shares * np.log2(shares)).sum()),
        kinds[1] / max(kinds[0], 1e-9),
        np.log1p(len(words)),
        (n - counts[32] - counts[10]) / n_words,
        len(distinct) / n_words,
        max(map(len, distinct), default=0) ** 0.5,
        sum(map(len, distinct)) / max(len(distinct), 1),
        np.log1p(len(lines)),
        len(set(lines)) / n_lines,
        np.log1p(n / n_lines),
    ]


def described(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, carried columns, x): the statistics of each text."""
    kept = ["doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = _matrix(part.column("text"))
                rows = pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), rows], names=[*kept, "x"])

    kinds = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in kept)
    return docs.select(*kept, "text").mapInArrow(run, f"{kinds}, x array<double>")


def _matrix(texts: pa.Array) -> np.ndarray:
    data, offsets = raw(texts)
    bounds = offsets.tolist()
    whole = data.tobytes()
    return np.array([statistics(whole[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]).reshape(-1, STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_score(x), self.edges, self.values), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, with a constant in front."""
    rng = np.random.default_rng(SEED)
    direction = rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES - 1))
    phase = rng.uniform(0, 2 * np.pi, FEATURES - 1)
    waves = np.sqrt(2 / (FEATURES - 1)) * np.cos(np.clip(z, -8, 8) @ direction + phase)
    return np.concatenate([np.ones((len(z), 1)), waves], axis=1)


def _equations(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over all rows, by partition and then in a tree."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, FEATURES + 1))
        n = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                f = fourier((np.array(part.column("x").to_pylist()).reshape(-1, STATISTICS) - mean) / scale)
                y = part.column("y").to_numpy(zero_copy_only=False)
                total += f.T @ np.concatenate([f, y[:, None]], axis=1)
                n += len(f)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part"):
                x = np.frombuffer(part.as_py())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    sums = rows.mapInArrow(own, "part binary")
    sums = written(sums, "equations")
    n = sums.count()
    while n > FAN:
        sums = written(sums.repartition(-(-n // FAN)).mapInArrow(added, "part binary"), "equations")
        n = sums.count()
    total = sum((np.frombuffer(r.part) for r in sums.toLocalIterator()), np.zeros(FEATURES * (FEATURES + 1)))
    total = total.reshape(FEATURES, FEATURES + 1)
    return total[:, :-1], total[:, -1]


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest rising sequence by weighted squares: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def fit(described_docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model | None:
    """Learn from labelled rows (doc_id, quality) for which `may_learn` holds; None if there are none."""
    labels = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = written(described_docs.where(may_learn).select("doc_id", "x").join(labels, "doc_id").select("x", "y"), "labelled")
    moments = rows.select(
        F.count("*").alias("n"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(STATISTICS)),
        *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(STATISTICS)),
    ).first()
    if not moments.n:
        return None
    mean = np.array([moments[f"m{i}"] for i in range(STATISTICS)])
    scale = np.array([moments[f"s{i}"] for i in range(STATISTICS)])
    scale = np.where(scale > 1e-9, scale, 1.0)
    left, right = _equations(rows, mean, scale)
    ridge = np.eye(FEATURES) * RIDGE
    ridge[0, 0] = 1e-6
    inverse = np.linalg.inv(left + ridge)
    model = Model(mean, scale, inverse @ right, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = fourier((np.array(batch.column("x").to_pylist()).reshape(-1, STATISTICS) - mean) / scale)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                leverage = np.minimum(((f @ inverse) * f).sum(axis=1), 1 - 1e-6)
                s = (f @ model.weights - leverage * y) / (1 - leverage)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.clip(np.floor((s + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)), pa.array(s), batch.column("y")],
                    names=["bin", "s", "y"],
                )

    bins = (
        rows.mapInArrow(binned, "bin int, s double, y double")
        .groupBy("bin")
        .agg(F.count("*").alias("n"), F.avg("s").alias("s"), F.avg("y").alias("y"))
        .orderBy("bin")
        .collect()
    )
    model.edges = np.array([b.s for b in bins])
    model.values = isotonic(np.array([b.y for b in bins]), np.array([b.n for b in bins], float))
    return model


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of `docs` (doc_id, text): held_out, score, predicted (score >= 0.7).

    Labels (doc_id, quality) of held out documents are not learned from. A null text
    counts as empty; empty texts get the score of their all-zero statistics. Without
    any label to learn from all scores are 0.5. Repeated rows score alike, repeated
    labels each count, and a null doc_id passes through and is not learned from.
    """
    out = F.coalesce(held_out, F.lit(False))
    rows = written(described(_inputs(docs).withColumn("held_out", out), "held_out"), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, ~F.col("held_out")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, STATISTICS)
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """`docs` without the rows predicted 0; all columns stay. Without labels all rows stay."""
    out = F.coalesce(held_out, F.lit(False))
    rows = written(described(_inputs(docs).withColumn("held_out", out), "held_out"), "statistics")
    model = fit(rows, labels, ~F.col("held_out"))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(shared.value.score(_matrix(part.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Held out of the learning: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out()
    )
