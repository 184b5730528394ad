"""A keyed table that micro-batches change: each writes only the rows it touches.

A batch's rows lie in a folder of their own, dealt into buckets by a hash of the key;
of a key's rows the one of the latest batch holds. A batch reads only the buckets that
its own keys fall into, and only what earlier batches wrote, and it replaces its own
folder, so running it again after a failure gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str):
        self.spark, self.folder, self.keys, self.schema = spark, folder.rstrip("/"), keys, schema
        self.rest = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in keys]

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def _casts(self) -> list[str]:
        return [f"cast({name} as {kind}) {name}" for name, kind in (c.split() for c in self.schema.split(", "))]

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, rows: DataFrame, number: int) -> None:
        """The new rows of batch ``number``; a row with ``gone`` true removes its key."""
        if "gone" not in rows.columns:
            rows = rows.withColumn("gone", F.lit(False))
        rows = rows.selectExpr(*self._casts(), "gone").withColumn("bucket", self._bucket())
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={number}")

    def read(self, before: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """Current rows; those written before a batch, in the buckets of the keys in ``like``."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, gone boolean, batch bigint, bucket int").parquet(self.folder)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if like is not None:
            # Hashes depend on the type, so keys are first cast to the table's. At most BUCKETS numbers.
            typed = like.selectExpr(*(c for c in self._casts() if c.split()[-1] in like.columns))
            touched = [r[0] for r in typed.select(self._bucket()).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(touched))
        last = F.max_by(F.struct(*self.rest, "gone"), "batch").alias("last")
        current = rows.groupBy(*self.keys).agg(last).where("not last.gone")
        columns = [c.split()[0] for c in self.schema.split(", ")]
        return current.select(*(c if c in self.keys else F.col(f"last.{c}").alias(c) for c in columns))
