"""Question payloads: decoding, defaults and the reject split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import fixed_values as V
from casebook.schemas import REQUEST


def _option(options: Column, key: str, default: str) -> Column:
    """A default fills a missing key only; an explicit null stays null."""
    has_key = F.coalesce(F.map_contains_key(options, key), F.lit(False))
    return F.when(has_key, options[key]).otherwise(F.lit(default))


def _number(text: Column) -> Column:
    """A loosely typed number: blank and false are 0, true is 1, what is no number is NaN; null stays null."""
    trimmed = F.trim(text)
    plain = trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return (
        F.when(text.isNull(), F.lit(None).cast("double"))
        .when(trimmed.isin("", "false"), 0.0)
        .when(trimmed == "true", 1.0)
        .when(plain, trimmed.try_cast("double"))
        .otherwise(F.lit(float("nan")))
    )


def decode_requests(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Replace the JSON column by question, character, tone and illustration.

    A tone that is no number becomes NaN, which compares as neither low nor high.
    """
    decoded = df.withColumn("_request", F.from_json(payload, REQUEST)).drop(payload)
    options = F.col("_request.options")
    return decoded.select(
        *[c for c in decoded.columns if c != "_request"],
        F.col("_request.question").alias("question"),
        _option(options, "character", V.DEFAULT_CHARACTER).alias("character"),
        _number(_option(options, "toneValue", str(V.DEFAULT_TONE))).alias("tone"),
        _option(options, "illustrationType", V.DEFAULT_ILLUSTRATION).alias("illustration"),
    )


def mark_rejects(df: DataFrame, question: str = "question") -> DataFrame:
    """Flag requests without a question; ``valid`` feeds the two sinks."""
    valid = F.coalesce(F.col(question) != "", F.lit(False))
    return df.withColumn("valid", valid).withColumns(
        {
            "status": F.when(valid, V.ACCEPT_STATUS).otherwise(V.REJECT_STATUS),
            "code": F.when(~valid, F.lit(V.REJECT_CODE)),
            "details": F.when(~valid, F.lit(V.REJECT_DETAILS)),
        }
    )


def write_split(marked: DataFrame, folder: str) -> None:
    """Accepted and rejected requests to their own folders below ``folder``, in one pass."""
    marked.write.mode("append").partitionBy("valid").parquet(folder)


def read_split(spark: SparkSession, folder: str, valid: bool) -> DataFrame:
    """One side of the split; only its folder is read."""
    side = spark.read.parquet(folder).filter(F.col("valid") == valid).drop("valid")
    return side.drop("status", "code", "details") if valid else side
