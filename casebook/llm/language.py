"""Language identification by a small convolutional network over bytes.

Filters of several widths slide over fixed windows of bytes (A-Z in lower case),
each filter's largest value in the window is kept (max pooling), and a softmax
layer turns these into language probabilities. The network is trained in NumPy on
the driver, on a bounded sample of labelled documents: at most `PER_LANGUAGE`
documents of a language, fewer where `SAMPLE_DOCS` are shared by many languages,
those with the smallest hash of their id. Prediction
runs over all windows of every text; a text's probabilities are the mean over its
windows, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.llm.batches import ASCII_LOWER, raw, slices
from casebook.session import written

WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bytes in a window; windows overlap by the widest filter less one.
WINDOW = 256
STEP = WINDOW - max(WIDTHS) + 1
#: Bounds of the training sample: documents of a language, documents in all (at least one of each language),
#: characters of a document.
PER_LANGUAGE, SAMPLE_DOCS, SAMPLE_CHARS = 400, 80_000, 2048
#: Parts that a language's documents are dealt into before its smallest hashes are picked.
SALTS = 64
EPOCHS, MINIBATCH, RATE, SEED = 6, 64, 0.01, 7
#: Windows handled at once.
BLOCK = 128

UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray  # (FILTERS * number of widths)
    weights: np.ndarray  # (FILTERS * number of widths, languages)
    offset: np.ndarray  # (languages)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Filters summed over pairs of bytes, so that a pair is one lookup; and the third byte's part."""
        first, second = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        two, three, four = (self.filters[w] for w in WIDTHS)
        pairs = [two[0][first] + two[1][second], three[0][first] + three[1][second]]
        pairs += [four[0][first] + four[1][second], four[2][first] + four[3][second]]
        return np.ascontiguousarray(np.concatenate(pairs, axis=1)), three[2].copy()

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pairs, third = tables
        n = FILTERS
        out = pairs.take(windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:], axis=0)
        pooled = np.concatenate(
            [
                out[:, :, :n].max(axis=1),
                (out[:, :-1, n : 2 * n] + third.take(windows[:, 2:], axis=0)).max(axis=1),
                (out[:, :-2, 2 * n : 3 * n] + out[:, 2:, 3 * n :]).max(axis=1),
            ],
            axis=1,
        )
        return softmax(np.maximum(pooled + self.bias, 0) @ self.weights + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of WINDOW bytes from each start, zeros from its text's end on."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], data.take(np.minimum(at, max(len(data) - 1, 0))), 0).astype(np.uint8)


def train(texts: list[str], labels: list[str]) -> Network | None:
    """Fit the network by Adam on windows of the texts, some of them short; None without texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    number = {name: n for n, name in enumerate(languages)}
    rng = np.random.default_rng(SEED)
    rows, y = [], []
    for text, label in zip(texts, labels, strict=True):
        data = ASCII_LOWER[np.frombuffer(text.encode(), np.uint8)]
        for k in range(4):
            size = WINDOW if k < 2 else int(rng.integers(16, WINDOW + 1))
            start = int(rng.integers(0, max(1, len(data) - size + 1)))
            row = np.zeros(WINDOW, np.uint8)
            piece = data[start : start + size]
            row[: len(piece)] = piece
            rows.append(row)
            y.append(number[label])
    x, y = np.array(rows), np.array(y)
    n = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(n, np.float32),
        rng.normal(0, 0.1, (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    parameters = [*net.filters.values(), net.bias, net.weights, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(x), MINIBATCH):
            chosen = order[start : start + MINIBATCH]
            step += 1
            gradients = _gradients(net, x[chosen], y[chosen])
            for p, g, (m, v) in zip(parameters, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    best, pooled = [], []
    for w in WIDTHS:
        size = WINDOW - w + 1
        value = sum(net.filters[w][j].take(x[:, j : j + size], axis=0) for j in range(w))
        place = value.argmax(axis=1)
        best.append(place)
        pooled.append(np.take_along_axis(value, place[:, None, :], axis=1)[:, 0])
    hidden = np.concatenate(pooled, axis=1) + net.bias
    active = np.maximum(hidden, 0)
    slope = softmax(active @ net.weights + net.offset)
    slope[np.arange(len(y)), y] -= 1
    slope /= len(y)
    back = (slope @ net.weights.T) * (hidden > 0)
    out = []
    rows = np.arange(len(x))[:, None]
    for k, w in enumerate(WIDTHS):
        g = np.zeros_like(net.filters[w])
        own = back[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (x[rows, best[k] + j], np.arange(FILTERS)[None, :]), own)
        out.append(g)
    return [*out, back.sum(axis=0), active.T @ slope, slope.sum(axis=0)]


def sample(docs: DataFrame, may_learn: Column) -> tuple[list[str], list[str]]:
    """The training texts and their languages: a stretch of each sampled document, at a place set by its id's hash."""
    labelled = docs.where(may_learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    languages = labelled.select("lang").distinct().count()
    if not languages:
        return [], []
    most = min(PER_LANGUAGE, max(1, SAMPLE_DOCS // languages))
    # A frequent language is first cut within its salts, so that no task sees more than SALTS * most of its rows at the end.
    few = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("order"), F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).alias("salt"))
    for keys in (["lang", "salt"], ["lang"]):
        window = Window.partitionBy(*keys).orderBy("order", "doc_id")
        few = few.withColumn("place", F.row_number().over(window)).where(F.col("place") <= most).drop("place")
    few = written(few.select("doc_id", "lang").distinct(), "language-sample")
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))
    stretch = F.substring(F.col("text"), F.pmod(F.xxhash64("doc_id", F.lit("place")), room).cast("int") + 1, F.lit(SAMPLE_CHARS))
    rows = (
        labelled.join(few, ["doc_id", "lang"])
        .where(F.col("text").rlike(r"\p{L}"))
        .select("doc_id", "lang", stretch.alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.text))
    return [r.text for r in rows], [r.lang for r in rows]


def languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): held_out, lang_pred, score.

    `held_out` says of a row whether its label is kept from the training; predictions
    read the text alone. A null text or one without a letter is `und` with score 1,
    and so is every text, with score 0, if nothing was there to learn from. Repeated
    rows are predicted alike; a null doc_id passes through and is not learned from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = F.coalesce(held_out, F.lit(False))
    network = train(*sample(docs, ~out))
    shared = docs.sparkSession.sparkContext.broadcast((network, network.tables() if network else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                lettered = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                names = np.full(part.num_rows, UNKNOWN, object)
                scores = np.where(lettered, 0.0, 1.0)
                if net and lettered.any():
                    chances = predict(net, tables, part.column("text"))
                    names[lettered] = np.array(net.languages, object)[chances.argmax(axis=1)][lettered]
                    scores[lettered] = np.clip(chances.max(axis=1), 0, 1)[lettered]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(scores)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return docs.select(
        "doc_id", "text", out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predict(net: Network, tables: tuple[np.ndarray, np.ndarray], texts: pa.Array) -> np.ndarray:
    """Language probabilities of each text, all its windows counted."""
    data, offsets = raw(texts)
    data = ASCII_LOWER[data]
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(sizes - WINDOW + STEP) // STEP))
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    doc = np.repeat(np.arange(len(sizes)), counts)
    starts = offsets[:-1][doc] + (np.arange(len(doc)) - firsts[doc]) * STEP
    ends = offsets[1:][doc]
    chances = np.empty((len(doc), len(net.languages)), np.float64)
    for k in range(0, len(doc), BLOCK):
        chances[k : k + BLOCK] = net.probabilities(windows_of(data, starts[k : k + BLOCK], ends[k : k + BLOCK]), tables)
    weights = np.clip(ends - starts, 1, WINDOW).astype(np.float64)
    total = np.add.reduceat(chances * weights[:, None], firsts, axis=0)
    return total / np.add.reduceat(weights, firsts)[:, None]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)
