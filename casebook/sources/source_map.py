"""Item-to-source map: nested JSON whose object keys are titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.schemas import SOURCE_MAP


def explode_map(df: DataFrame, keys: list[str], maps: str, key: str, value: str) -> DataFrame:
    """Distinct (keys, map key, map value) of an array of maps."""
    return (
        df.select(*keys, F.explode(maps).alias("_map"))
        .select(*keys, F.explode("_map").alias(key, value))
        .distinct()
    )


def explode_variant(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """Distinct (keys, key, kind, value) of JSON objects whose keys and types are not known beforehand.

    `kind` is object, array, string, number, boolean or null; `value` is a string's
    text, null for null, and JSON text for anything else. A text that is null, no JSON,
    no object, or repeats a key within an object gives no rows.
    """
    member = df.sparkSession.tvf.variant_explode(F.col("_json").outer())
    kind = F.schema_of_variant("value")
    return (
        df.select(*keys, F.try_parse_json(json).alias("_json"))
        .where(F.schema_of_variant("_json").startswith("OBJECT"))
        .lateralJoin(member)
        .select(
            *keys,
            "key",
            F.when(kind.startswith("OBJECT"), "object")
            .when(kind.startswith("ARRAY"), "array")
            .when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean")
            .when(kind == "VOID", "null")
            .otherwise("number")
            .alias("kind"),
            F.col("value").cast("string").alias("value"),
        )
        .distinct()
    )


def read_source_map(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (id, title, url)."""
    nested = spark.read.schema(SOURCE_MAP).json(path, multiLine=True)
    return explode_map(nested, ["id"], "sources", "title", "url")
