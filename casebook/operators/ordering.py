"""Numbering and top-k within groups, safe when one group holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casebook.session import written

# Up to this bound Spark cuts a group before the shuffle.
GROUP_LIMIT = 1000
# Inputs below this size are spread over the cores.
SPREAD_BELOW = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Use every core for row-local work on a small input, which may be one file.

    Anything above ``SPREAD_BELOW`` passes unchanged, so nothing large is ever
    shuffled here.
    """
    spark = df.sparkSession
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate < SPREAD_BELOW:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "n") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1.

    The literal bound lets Spark cut each group to ``k`` rows before the shuffle,
    so a hot group sends at most ``k`` rows per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).filter(F.col(name) <= F.lit(k))


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add running sums within each group by ``order`` (ascending, keys not null).

    The rows are cut into ranges of the whole order, keys first, so a hot group is
    many ranges even if its first order column ties. Each range is summed on its own
    and shifted by the sums of the group's ranges before it. The ranges are written
    once, because a task that runs again must find the same ones.
    """
    values = [f"_{name}" for name in totals]
    ranged = df.withColumns({f"_{name}": value.cast("bigint") for name, value in totals.items()})
    ranged = written(ranged.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = [*keys, "_part"]
    window = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumns({v[1:]: F.sum(v).over(window) for v in values})
    # A row for each group and range: as many as groups, and a few for those that ranges cut.
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy(*within)
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(*within, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_shift{v}") for v in values])
    )
    shifted = summed.join(shifts, within)
    return shifted.withColumns(
        {v[1:]: F.col(v[1:]) + F.col(f"_shift{v}") for v in values}
    ).drop("_part", *values, *[f"_shift{v}" for v in values])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Number all rows of each group from 1."""
    return running_totals(df, keys, order, {name: F.lit(1)})
