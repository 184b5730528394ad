"""Small configuration files: FAQ entries and practice scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.schemas import FAQ_FILE, SCENARIO

FAQ_DEFAULT_KEY = "default"


@dataclass(frozen=True)
class FaqEntry:
    keyword: str
    lawyer_text: str
    normal_text: str
    lawyer_comic: str | None = None
    lawyer_poster: str | None = None
    normal_comic: str | None = None
    normal_poster: str | None = None


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """(priority, keyword, texts, pictures) in declaration order.

    The file is one JSON object: keyword -> {lawyer, normal} -> {text, comic, poster},
    with the key ``default`` for the entry used when no keyword occurs.
    """
    raw = spark.read.text(path, wholetext=True)
    entry = F.col("entry")
    return raw.select(
        F.posexplode(F.from_json("value", FAQ_FILE)).alias("priority", "keyword", "entry")
    ).select(
        "priority",
        "keyword",
        *[
            entry[side][field].alias(f"{side}_{field}")
            for side in ("lawyer", "normal")
            for field in ("text", "comic", "poster")
        ],
    )


def faq_entries(faq: DataFrame) -> tuple[list[FaqEntry], FaqEntry]:
    """The configuration as Python values: keyword entries in order, and the default."""
    rows = [r.asDict() for r in faq.orderBy("priority").collect()]
    for row in rows:
        row.pop("priority")
    entries = [FaqEntry(**row) for row in rows]
    keyed = [e for e in entries if e.keyword != FAQ_DEFAULT_KEY]
    default = next(e for e in entries if e.keyword == FAQ_DEFAULT_KEY)
    return keyed, default


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENARIO).json(path, multiLine=True)
