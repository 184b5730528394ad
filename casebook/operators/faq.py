"""FAQ answers: keyword match, tone, illustration.

The keyword list is configuration, so it becomes literals in the plan: a chain of
conditions that stops at the first match, with no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.labels import blended_text, illustration
from casebook.sources.catalogues import FaqEntry


def match_position(question: Column, entries: list[FaqEntry]) -> Column:
    """Position of the first keyword the question contains, else the number of entries."""
    lowered = F.lower(question)
    chain = F
    for position, entry in enumerate(entries):
        chain = chain.when(F.contains(lowered, F.lit(entry.keyword)), F.lit(position))
    return chain.otherwise(F.lit(len(entries))) if entries else F.lit(0)


def _entry_field(position: Column, entries: list[FaqEntry], default: FaqEntry, name: str) -> Column:
    values = [F.lit(getattr(e, name)).cast("string") for e in [*entries, default]]
    return F.get(F.array(*values), position)


def match_faq(
    df: DataFrame, entries: list[FaqEntry], default: FaqEntry, question: str = "question"
) -> DataFrame:
    """Add ``faq_no`` (position in declaration order) and ``keyword``."""
    position = match_position(F.col(question), entries)
    return df.withColumn("faq_no", position).withColumn(
        "keyword", _entry_field(F.col("faq_no"), entries, default, "keyword")
    )


def answer_requests(df: DataFrame, entries: list[FaqEntry], default: FaqEntry, at: Column) -> DataFrame:
    """Answers for decoded requests (question, character, tone, illustration).

    The text follows the tone table, the illustration follows the character.
    """
    matched = match_faq(df, entries, default)

    def field(name: str) -> Column:
        return _entry_field(F.col("faq_no"), entries, default, name)

    is_lawyer = F.col("character") == "lawyer"
    comic = F.when(is_lawyer, field("lawyer_comic")).otherwise(field("normal_comic"))
    poster = F.when(is_lawyer, field("lawyer_poster")).otherwise(field("normal_poster"))
    text = blended_text(
        F.col("character"), F.col("tone"), field("lawyer_text"), field("normal_text")
    )
    kept = [c for c in df.columns if c not in ("question", "character", "tone", "illustration")]
    return matched.select(
        *kept,
        text.alias("text"),
        "character",
        at.alias("timestamp"),
        illustration(F.col("illustration"), comic, poster).alias("illustration"),
    )
