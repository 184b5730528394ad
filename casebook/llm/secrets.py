"""Secrets in texts, with DataFrame functions only.

Three fixed kinds are found by pattern. On top, each maximal stretch of a character
class (hexadecimal digits; letters and digits; those and the marks of base64) that is
long enough gets the Shannon entropy of each of its windows: the characters that
enter and leave a window change one count each, so the entropy is carried from
window to window in one fold. Each class has its own threshold. From the first to
the last window above it the stretch is hot, and the hot part is a span unless the
allow-list knows each of its parts between marks. Entropies are compared as whole
numbers (counts times logarithms in units of 2 ** -20), so the result does not depend
on rounding.

Long texts: no pattern repeats a group, so none recurses; places, windows and masks
are worked out in blocks, so time stays near the length of the text and what a row
holds near its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed kinds, in the order of results: pattern, group whose length counts, least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_START = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A run that is too short fails whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Kinds by entropy: stretches, characters of the class, bits a character in a window at least.
CLASSES = {
    "entropy_hex": (r"[0-9a-fA-F]{20,}", "0123456789abcdefABCDEF", 3.0),
    "entropy_text": (r"[A-Za-z0-9]{20,}", LETTERS + "0123456789", 3.6),
    "entropy_mixed": (r"[A-Za-z0-9+/_-]{20,}", LETTERS + "0123456789+/_-", 3.75),
}
KINDS = (*BASE_KINDS, *CLASSES)
#: Where a hot part is cut before the allow-list sees it.
MARKS = r"[+/_-]"
#: Parts that are no secrets: digits, capitals with a number, samples, alphabets. Each is anchored.
ALLOWED = (
    r"^[A-Z]*[0-9]*$",
    r"(?i)^(?:example|sample|placeholder|changeme|dummy|xxxxxx)",
    r"(?i)(?:example|sample|placeholder|changeme|dummy|xxxxxx)(?:key|token|secret)?$",
    r"(?i)^(?:abcdefghij|0123456789abcdef|1234567890|qwertyuiop)",
)
#: Words in camel case with a number behind them are none either: WORDS, but not BROKEN (a capital before another or a digit).
WORDS, BROKEN = r"^[A-Za-z]*[0-9]*$", r"[A-Z][A-Z0-9]"
#: Nor are the parts of an identifier such as 8-4-4-4-12 hexadecimal digits: IDENTIFIER, but not LONG_PART.
IDENTIFIER, LONG_PART = r"^[0-9a-fA-F]*-[-0-9a-fA-F]*$", r"[0-9a-fA-F]{13}"
#: Hits, windows and spans worked out at once.
BLOCK = 256
WINDOW_BLOCK = 4096
UNIT = 1 << 20
MASK = "[secret]"


def _weight(n: int) -> int:
    return round(n * math.log2(n) * UNIT) if n else 0


def most(kind: str) -> int:
    """Largest sum of n log n over a window's counts n at which its entropy is at the threshold."""
    return math.floor((math.log2(WINDOW) - CLASSES[kind][2]) * WINDOW * UNIT)


def _blocks(rows: Column, length: int) -> Column:
    """An array cut into arrays of `length`."""
    many = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / length).cast("int")))
    return F.transform(F.coalesce(many, F.array().cast("array<int>")), lambda b: F.slice(rows, b * length + 1, length))


def _placed(text: Column, pattern: str, wanted: Column | None = None) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, as (at, to, counted, own) by code points."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = wanted if wanted is not None else F.transform(hits, F.length)
    row = F.arrays_zip(
        F.transform(F.slice(pieces, 1, F.size(hits)), F.length).alias("gap"),
        F.transform(hits, F.length).alias("size"),
        sizes.alias("counted"),
        hits.alias("own"),
    )
    none = F.array().cast("array<struct<at:int,to:int,counted:int,own:string>>")

    def step(state: Column, x: Column) -> Column:
        at = state["to"] + x["gap"]
        to = at + x["size"]
        hit = F.struct(at.alias("at"), to.alias("to"), x["counted"].alias("counted"), x["own"].alias("own"))
        return F.struct(to.alias("to"), F.concat(state["out"], F.array(hit)).alias("out"))

    def block(state: Column, rows: Column) -> Column:
        done = F.aggregate(rows, F.struct(state["to"].alias("to"), none.alias("out")), step)
        return F.struct(done["to"].alias("to"), F.concat(state["out"], done["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("to"), none.alias("out"))
    return F.aggregate(_blocks(row, BLOCK), start, block, lambda s: s["out"])


def _hot(own: Column, kind: str) -> Column:
    """(first, last): the part of a stretch from its first to its last window at or above the threshold; first -1 without one.

    The counts of a window are a string, one character for each of the class.
    """
    alphabet = CLASSES[kind][1]
    gains = F.array(*(F.lit(_weight(n + 1) - _weight(n)) for n in range(WINDOW + 1)))

    def count(counts: Column, place: Column) -> Column:
        return F.ascii(F.substr(counts, place, F.lit(1))) - 48

    def changed(counts: Column, old: Column, place: Column, by: int) -> Column:
        return F.overlay(counts, F.char(count(old, place) + (48 + by)), place, 1)

    def step(state: Column, x: Column) -> Column:
        """The window before this character is judged, then the character enters and the first one leaves."""
        counts, enters, leaves = state["counts"], x["enters"], x["leaves"]
        hot = (x["i"] >= WINDOW) & (state["total"] <= most(kind))
        up, down = F.get(gains, count(counts, enters)), F.get(gains, count(counts, leaves) - 1)
        more = changed(counts, counts, enters, 1)
        return F.struct(
            F.when(leaves == enters, counts).when(leaves > 0, changed(more, counts, leaves, -1)).otherwise(more).alias("counts"),
            F.when(leaves == enters, state["total"]).when(leaves > 0, state["total"] + up - down).otherwise(state["total"] + up).alias("total"),
            F.when(hot & (state["first"] < 0), x["i"] - WINDOW).otherwise(state["first"]).alias("first"),
            F.when(hot, x["i"]).otherwise(state["last"]).alias("last"),
        )

    start = F.struct(
        F.lit("0" * len(alphabet)).alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )

    def block(at: Column) -> Column:
        """The windows that begin in one block."""

        def folded(codes: Column) -> Column:
            # A character leaves when the one WINDOW places later enters. One more row judges the last window.
            rows = F.transform(
                F.concat(codes, F.array(F.lit(1))),
                lambda c, i: F.struct(
                    c.alias("enters"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(0).alias("leaves"), i.alias("i")
                ),
            )
            return F.aggregate(
                rows,
                start,
                step,
                lambda s: F.struct(
                    F.when(s["first"] >= 0, s["first"] + at).alias("first"), F.when(s["first"] >= 0, s["last"] + at).alias("last")
                ),
            )

        letters = F.split(F.substr(own, at + 1, F.lit(WINDOW_BLOCK + WINDOW - 1)), "")
        codes = F.transform(letters, lambda c: F.instr(F.lit(alphabet), c))
        return F.get(F.transform(F.array(codes), folded), F.lit(0))

    blocks = F.transform(F.sequence(F.lit(0), F.length(own) - WINDOW, F.lit(WINDOW_BLOCK)), block)
    span = lambda all_: F.struct(
        F.coalesce(F.array_min(F.transform(all_, lambda b: b["first"])), F.lit(-1)).alias("first"),
        F.coalesce(F.array_max(F.transform(all_, lambda b: b["last"])), F.lit(-1)).alias("last"),
    )
    return F.get(F.transform(F.array(blocks), span), F.lit(0))


SPAN = "struct<at:int,kind:int,to:int>"
NO_SPANS = f"array<{SPAN}>"


def spans(text: Column) -> Column:
    """All spans of a text as array<struct<at, kind (place in KINDS), to>>, by start, kind and end."""
    none = F.array().cast(NO_SPANS)

    def span(hit: Column, kind: int) -> Column:
        return F.struct(hit["at"].alias("at"), F.lit(kind).alias("kind"), hit["to"].alias("to"))

    assigned = F.transform(
        F.filter(
            _placed(text, ASSIGN, F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.length)),
            lambda h: h["counted"] >= 8,
        ),
        lambda h: span(h, 0),
    )
    access = F.transform(_placed(text, ACCESS), lambda h: span(h, 1))
    hexes = F.transform(_placed(text, HEX), lambda h: span(h, 2))

    def hot(kind: str) -> Column:
        """Spans of one class."""
        parts = F.transform(
            _placed(text, CLASSES[kind][0]),
            lambda h: F.transform(
                F.filter(F.array(_hot(h["own"], kind)), lambda x: x["first"] >= 0),
                lambda x: F.struct(
                    (h["at"] + x["first"]).alias("at"),
                    F.lit(KINDS.index(kind)).alias("kind"),
                    (h["at"] + x["last"]).alias("to"),
                    F.substr(h["own"], x["first"] + 1, x["last"] - x["first"]).alias("own"),
                ),
            ),
        )
        found = F.filter(F.flatten(parts), lambda x: ~_allowed(x["own"]))
        found = F.transform(found, lambda x: F.struct(x["at"], x["kind"], x["to"])).cast(NO_SPANS)
        return F.when(text.rlike(CLASSES[kind][0]), found).otherwise(none)

    return F.array_sort(
        F.concat(
            F.when(text.rlike(ASSIGN_START), assigned).otherwise(none),
            F.when(text.rlike(ACCESS), access).otherwise(none),
            F.when(text.rlike(HEX), hexes).otherwise(none),
            *map(hot, CLASSES),
        )
    )


def _allowed(hot: Column) -> Column:
    """Whether a hot part is an identifier by form, or each part between marks is no secret."""

    def known(part: Column) -> Column:
        out = part.rlike(WORDS) & ~part.rlike(BROKEN)
        for pattern in ALLOWED:
            out = out | part.rlike(pattern)
        return out

    return (hot.rlike(IDENTIFIER) & ~hot.rlike(LONG_PART)) | F.forall(F.split(hot, MARKS, -1), known)


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"].cast("string"), s["to"].cast("string"))), ","
    )


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts of the fixed kinds, their digest, and all spans.

    A null text counts as empty, an empty one has no spans. Spans of different kinds
    may overlap. Repeated rows and null doc_ids pass through.
    """
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), spans(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("found")
    )
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE_KINDS))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def masked(text: Column, found: Column) -> Column:
    """The text with each stretch that spans cover (overlapping ones together) replaced by MASK.

    A block of spans takes its own part of the text once and works on that part.
    """
    none = F.array().cast("array<string>")

    def step(state: Column, s: Column) -> Column:
        gap = F.substr(state["text"], state["to"] - state["from"] + 1, F.greatest(s["at"] - state["to"], F.lit(0)))
        return F.struct(
            state["text"].alias("text"),
            state["from"].alias("from"),
            F.greatest(state["to"], s["to"]).alias("to"),
            F.when(s["at"] >= state["to"], F.concat(state["out"], F.array(gap, F.lit(MASK)))).otherwise(state["out"]).alias("out"),
        )

    def block(state: Column, spans: Column) -> Column:
        part = F.substr(text, state["to"] + 1, F.greatest(F.element_at(spans, -1)["at"] - state["to"], F.lit(0)))
        start = F.struct(part.alias("text"), state["to"].alias("from"), state["to"].alias("to"), none.alias("out"))
        done = F.aggregate(spans, start, step)
        return F.struct(done["to"].alias("to"), F.concat(state["out"], F.array(F.array_join(done["out"], ""))).alias("out"))

    def rest(s: Column) -> Column:
        return F.array_join(F.concat(s["out"], F.array(F.substr(text, s["to"] + 1, F.length(text)))), "")

    start = F.struct(F.lit(0).alias("to"), none.alias("out"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(_blocks(found, BLOCK), start, block, rest))


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with all spans masked; n_chars, if there is such a column, follows. All rows stay; null texts too."""
    name = next(n for k in range(len(docs.columns) + 1) if (n := f"found_{k}") not in docs.columns)
    found = docs.withColumn(name, F.when(F.col("text").isNotNull(), spans(F.col("text"))))
    new = found.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(name))))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new = new.withColumn(
            "n_chars", F.when(F.size(F.coalesce(name, F.array().cast(NO_SPANS))) == 0, F.col("n_chars")).otherwise(F.length("text").cast(kind))
        )
    return new.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: int, pattern: str, counted: int | None) -> str:
    """Matches of a pattern with their places; `counted`: the group whose length counts."""
    p = _quoted(pattern)
    value = f"regexp_extract_all(text, {p}, {counted})" if counted is not None else "hits"
    return f"""
  SELECT doc_id, {kind} AS kind, hits[i] AS own, length(counted[i]) AS counted,
    (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a0
  FROM (SELECT *, {value} AS counted, unnest(range(1, len(hits) + 1)) AS i
        FROM (SELECT doc_id, text, regexp_extract_all(text, {p}, 0) AS hits, string_split_regex(text, {p}) AS gaps
              FROM t WHERE regexp_matches(text, {p})))"""


def checking_sql() -> str:
    """The same result in DuckDB; each window's entropy is counted anew there."""
    part = " OR ".join(f"regexp_matches(part, {_quoted(p)})" for p in ALLOWED)
    stretches = "\n  UNION ALL ".join(_matches(KINDS.index(kind), pattern, None) for kind, (pattern, _, _) in CLASSES.items())
    limit = " ".join(f"WHEN {KINDS.index(kind)} THEN {most(kind)}" for kind in CLASSES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_matches(0, ASSIGN, 2)} UNION ALL {_matches(1, ACCESS, None)} UNION ALL {_matches(2, HEX, None)}),
candidates AS (SELECT *, row_number() OVER () AS c FROM ({stretches})),
windows AS (
  SELECT c, i, unnest(string_split(substr(own, i + 1, {WINDOW}), '')) AS ch
  FROM (SELECT c, own, unnest(range(0, length(own) - {WINDOW} + 1)) AS i FROM candidates)),
sums AS (
  SELECT c, i, sum(round(n * log2(n) * {UNIT})) AS total FROM (SELECT c, i, ch, count(*) AS n FROM windows GROUP BY ALL) GROUP BY ALL),
warm AS (
  SELECT c, min(i) AS first, max(i) + {WINDOW} AS last FROM sums JOIN candidates USING (c)
  WHERE total <= CASE kind {limit} END GROUP BY c),
parts AS (
  SELECT c, unnest(string_split_regex(substr(own, first + 1, last - first), '{MARKS}')) AS part FROM candidates JOIN warm USING (c)),
secret AS (
  SELECT c FROM parts
  WHERE NOT ({part} OR (regexp_matches(part, '{WORDS}') AND NOT regexp_matches(part, '{BROKEN}')))
  GROUP BY c),
hot AS (
  SELECT c, first, last FROM warm SEMI JOIN secret USING (c) JOIN candidates USING (c)
  WHERE NOT (regexp_matches(substr(own, first + 1, last - first), '{IDENTIFIER}')
    AND NOT regexp_matches(substr(own, first + 1, last - first), '{LONG_PART}'))),
spans AS (
  SELECT doc_id, kind, a0, a0 + length(own) AS a1 FROM base WHERE kind > 0 OR counted >= 8
  UNION ALL SELECT doc_id, kind, a0 + first, a0 + last FROM candidates JOIN hot USING (c)),
named AS (SELECT *, [{", ".join(map(_quoted, KINDS))}][kind + 1] || ':' || a0 || ':' || a1 AS name FROM spans)
SELECT t.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY a0, kind, a1) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY a0, kind, a1), '') AS spans
FROM t LEFT JOIN named USING (doc_id) GROUP BY t.doc_id
"""


SQL = checking_sql()
