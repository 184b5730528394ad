"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A `Rollup` is a folder with two tables, each a folder per committed batch:

* `entries`: what each batch set for a document (its counts and keys, or that it
  is gone), dealt out by hash of the id;
* `deltas`: the batch's signed additions to the totals. Totals are the sum over
  all deltas, so a batch never reads or rewrites what earlier batches summed.

A batch is written under its id and counts only once its marker exists. Committing
an id again does nothing; a run that died before its marker is written over. Batches
are numbered in the order of their commits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm.batches import slices
from casebook.llm.pieces import piece_counts
from casebook.session import fresh_path, written

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
#: A change: what happens to (doc_id, tokenizer), with the new keys and counts (not read for a delete).
CHANGE = "doc_id bigint, op string, source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint"
ENTRY = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, n_chars bigint, gone boolean, batch int"
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"


class Rollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, path: str) -> tuple[object, object]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def committed(self) -> dict[str, int]:
        """Ids of the committed batches and their numbers."""
        fs, at = self._file(f"{self.path}/commits")
        if not fs.exists(at):
            return {}
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return {name.partition("-")[2]: int(name.partition("-")[0]) for name in names if name[:1].isdigit()}

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/{number}-{name}" for name, number in self.committed().items()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def entries(self) -> DataFrame:
        """The current row of each document and tokenizer that is not gone."""
        newest = F.max(F.struct("batch", "gone", "source", "lang", "n_tokens", "n_chars")).alias("e")
        rows = self._read("entries", ENTRY).groupBy("doc_id", "tokenizer").agg(newest)
        return rows.where("not e.gone").select("doc_id", "tokenizer", "e.source", "e.lang", "e.n_tokens", "e.n_chars")

    def totals(self) -> DataFrame:
        """Sums over all documents by source, language and tokenizer; groups without documents are left out."""
        rows = self._read("deltas", DELTA).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return rows.where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def commit(self, batch_id: str, changes: DataFrame, unnamed: DataFrame | None = None) -> bool:
        """Apply a batch of changes (see CHANGE) once; False if the id is committed already.

        `insert` and `revise` set a document's row whether it was there or not, so
        neither can be counted twice; `delete` of an unknown document does nothing.
        Of several changes to a document in a batch that with the largest `seq` holds
        (a bigint column that may be left out; null comes first). Of equal `seq` a delete
        holds, then the larger op, then the larger counts; equal changes are one. Rows
        with a null doc_id, tokenizer or an unknown op are an error. Null sources and languages are groups of their own.
        `unnamed` are documents without an id (source, lang, tokenizer, n_tokens, n_chars):
        each row adds to the totals, and no later change can name it.
        """
        done = self.committed()
        if batch_id in done:
            return False
        if not batch_id or not all(c.isalnum() or c in "-_." for c in batch_id):
            raise ValueError("a batch id is made of letters, digits and -_.")
        number = max(done.values(), default=0) + 1
        new = changes.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in CHANGE.split(", ")), f"cast({'seq' if 'seq' in changes.columns else 0} as bigint) seq")
        checked = F.when(
            F.col("doc_id").isNull() | F.col("tokenizer").isNull() | ~F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False)),
            F.raise_error(F.lit("a change needs doc_id, tokenizer and a known op")),
        ).otherwise(F.col("op"))
        last = F.max(F.struct("seq", (F.col("op") == "delete").alias("gone"), "op", "n_tokens", "n_chars", "source", "lang")).alias("c")
        new = new.withColumn("op", checked).groupBy("doc_id", "tokenizer").agg(last)
        old = self.entries().select(
            "doc_id", "tokenizer", F.struct("source", "lang", "n_tokens", "n_chars").alias("was")
        )
        both = written(new.join(old, ["doc_id", "tokenizer"], "left"), "changes")
        gone = F.col("c.gone")
        name = f"{number}-{batch_id}"
        both.where(~gone | F.col("was").isNotNull()).select(
            "doc_id", "c.source", "c.lang", "tokenizer", "c.n_tokens", "c.n_chars", gone.alias("gone"), F.lit(number).alias("batch")
        ).write.mode("overwrite").parquet(f"{self.path}/entries/{name}")
        minus = both.where("was is not null").select(
            "was.source", "was.lang", "tokenizer", F.lit(-1).alias("sign"), "was.n_tokens", "was.n_chars"
        )
        plus = both.where(~gone).select("c.source", "c.lang", "tokenizer", F.lit(1).alias("sign"), "c.n_tokens", "c.n_chars")
        signed = minus.union(plus)
        if unnamed is not None:
            signed = signed.union(unnamed.select("source", "lang", "tokenizer", F.lit(1).alias("sign"), "n_tokens", "n_chars"))
        signed.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("n_docs"),
            F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"),
            F.sum(F.col("sign") * F.col("n_chars")).cast("long").alias("n_chars"),
        ).write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        fs, at = self._file(f"{self.path}/commits/{name}")
        fs.create(at, False).close()
        return True


def counted(docs: DataFrame, tokenizer: str = "piece_bpe_32k", model_path: str | None = None) -> DataFrame:
    """Each document's keys and counts, for its text and for its cleaned text (see `cleaned`), in one pass."""
    schema = "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long, clean_tokens long, clean_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                clean = [t or "" for t in part.column("clean").to_pylist()]
                n = part.num_rows
                counts = piece_counts(texts + [c for c, t in zip(clean, texts, strict=True) if c != t], model_path)
                rest = iter(counts[n:])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("doc_id", "source", "lang")),
                        pa.array([tokenizer] * n, pa.string()),
                        pa.array(counts[:n], pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([k if c == t else next(rest) for k, c, t in zip(counts[:n], clean, texts, strict=True)], pa.int64()),
                        pa.array([len(t) for t in clean], pa.int64()),
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return docs.selectExpr(
        "cast(doc_id as long) doc_id", "cast(source as string) source", "cast(lang as string) lang", "cast(text as string) text",
        r"regexp_replace(cast(text as string), '[#$%&*|!]+', '') clean",
    ).mapInArrow(run, schema)


def token_rollup(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after three batches over all documents, the last of them sent twice.

    1. every document is inserted with the counts of its whole text;
    2. documents whose quality label is 0 are revised: their text loses its runs of
       `#$%&*|!`, and the counts of the revised whole text replace the old ones;
    3. documents labelled toxic are deleted. This batch is sent again and changes nothing.

    Null texts count as empty. Repeated rows of a document are one document (that with
    the larger counts); each row with a null doc_id is a document of its own. An empty table
    has no totals.
    """
    spark = docs.sparkSession
    all_rows = written(counted(docs), "counts")
    rows, unnamed = all_rows.where("doc_id is not null"), all_rows.where("doc_id is null")
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 0).alias("poor"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    flagged = written(rows.join(flags.where("poor or toxic"), "doc_id"), "flagged")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    change = lambda df, op, tokens, chars: df.select(
        "doc_id", F.lit(op).alias("op"), "source", "lang", "tokenizer", F.col(tokens).alias("n_tokens"), F.col(chars).alias("n_chars")
    )
    rollup.commit("insert", change(rows, "insert", "n_tokens", "n_chars"), unnamed)
    rollup.commit("revise", change(flagged.where("poor"), "revise", "clean_tokens", "clean_chars"))
    taken_down = change(flagged.where("toxic"), "delete", "n_tokens", "n_chars")
    rollup.commit("delete", taken_down)
    rollup.commit("delete", taken_down)
    return rollup.totals()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
