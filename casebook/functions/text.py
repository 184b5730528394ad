"""Column helpers for text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters each kind of strip removes.
STRIP_CHARS = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
INPUT_TRIM_CHARS = (
    "\t\n\u000b\u000c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so that ``body`` can use it often without re-evaluation."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Strip all Unicode white space from both ends of stored text."""
    return F.btrim(text, F.lit(STRIP_CHARS))


def trim_input(text: Column) -> Column:
    """Trim typed input; unlike ``strip`` it also removes the byte-order mark."""
    return F.btrim(text, F.lit(INPUT_TRIM_CHARS))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def has_words(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\p{L}\p{N}]"))


def text_bucket(text: Column, buckets: int) -> Column:
    """Stable bucket of a string: the first 32 bits of its md5, modulo ``buckets``."""
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10)
    return F.pmod(head.cast("bigint"), F.lit(buckets))
