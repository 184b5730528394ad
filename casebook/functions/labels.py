"""Labels computed from one row: tone, timer, dates, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook import fixed_values as V


def tone_label(tone: Column) -> Column:
    return (
        F.when(F.isnan(tone), V.TONE_LABEL_BALANCED)
        .when(tone < V.TONE_LOW, V.TONE_LABEL_CASUAL)
        .when(tone > V.TONE_HIGH, V.TONE_LABEL_LEGAL)
        .otherwise(V.TONE_LABEL_BALANCED)
    )


def blended_text(character: Column, tone: Column, lawyer: Column, normal: Column) -> Column:
    """Answer text for a character and a tone between 0 and 100.

    A null tone counts as 0 in these comparisons; NaN is neither below nor above
    any threshold, so it takes the balanced text.
    """
    t = F.coalesce(tone, F.lit(0))
    plain = F.concat(F.lit(V.TONE_PREFIX_PLAIN), normal)
    balanced = F.concat(F.lit(V.TONE_PREFIX_BALANCED), lawyer)
    is_lawyer = character == "lawyer"
    return (
        F.when(F.isnan(t), balanced)
        .when(t < V.TONE_LOW, normal)
        .when(t < V.TONE_MIDDLE, F.when(is_lawyer, plain).otherwise(normal))
        .when(t == V.TONE_MIDDLE, balanced)
        .when(t <= V.TONE_HIGH, F.when(is_lawyer, lawyer).otherwise(balanced))
        .otherwise(lawyer)
    )


def illustration(kind: Column, comic: Column, poster: Column) -> Column:
    """struct<type, url, caption>, null when none is asked for or there is none."""
    url = F.when(kind == "comic", comic).when(kind == "poster", poster)
    caption = F.when(kind == "comic", V.CAPTION_COMIC).otherwise(V.CAPTION_POSTER)
    return F.when(
        (F.length(url) > 0),
        F.struct(kind.alias("type"), url.alias("url"), caption.alias("caption")),
    )


def timer_class(seconds: Column) -> Column:
    return (
        F.when(seconds <= V.CRITICAL_SECONDS, "critical")
        .when(seconds <= V.WARNING_SECONDS, "warning")
        .otherwise("")
    )


def _two_digits(number: Column) -> Column:
    text = number.cast("bigint").cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def timer_text(seconds: Column, pad_minutes: bool = True) -> Column:
    """mm:ss; the result page leaves the minutes unpadded."""
    minutes = F.floor(seconds / 60)
    head = _two_digits(minutes) if pad_minutes else minutes.cast("bigint").cast("string")
    return F.concat(head, F.lit(":"), _two_digits(F.pmod(seconds, F.lit(60))))


def clock_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "d/M/yyyy"), F.lit(""))


def stars(level: Column) -> Column:
    """One star per difficulty level."""
    return F.repeat(F.lit("⭐"), level.cast("int"))


def _grade(total: Column, field: int) -> Column:
    chain = None
    for row in V.GRADES:
        if row[0] is None:
            return chain.otherwise(row[field])
        test = total >= row[0]
        chain = F.when(test, row[field]) if chain is None else chain.when(test, row[field])
    raise ValueError("the last grade has to take the rest")


def grade(total: Column) -> Column:
    return _grade(total, 1)


def grade_label(total: Column) -> Column:
    return _grade(total, 2)
