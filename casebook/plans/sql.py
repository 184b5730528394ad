"""Shared parts of the checking SQL (DuckDB), mirroring ``inputs.py``."""

from __future__ import annotations

from casebook.fixed_values import BADGES
from casebook.functions.text import INPUT_TRIM_CHARS, STRIP_CHARS
from casebook.functions.vectors import HASH_DIM
from casebook.plans.inputs import FAQ, FAQ_DEFAULT, ROUTE_RULES


def quote(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


STRIP = quote(STRIP_CHARS)
TRIM = quote(INPUT_TRIM_CHARS)

DOCS = f"docs AS (SELECT * FROM documents WHERE trim(text, {STRIP}) <> '')"


def _pieces(name: str, source: str, path: str, separator: str) -> str:
    sep = "||".join(["chr(10)"] * len(separator)) if separator.strip(" ") == separator else "' '"
    return f"""
{name} AS (
  SELECT doc_id, {path}unnest(range(1, len(a) + 1)) AS i, unnest(a) AS piece
  FROM (SELECT doc_id, {path}list_filter(
          string_split(replace(text, {sep}, chr(30) || {sep}), chr(30)),
          lambda x: x <> '') AS a
        FROM {source}))"""


def _runs(name: str, source: str, path: str, o1: str, o2: str, o3: str) -> str:
    part = f"doc_id{', ' + path if path else ''}"
    return f"""
{name} AS (
  SELECT doc_id, {o1} AS o1, {o2} AS o2, {o3} AS o3,
         list(piece ORDER BY i) AS pieces, list(cs ORDER BY i) AS cs
  FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY {part}, run ORDER BY i)::BIGINT AS cs
        FROM (SELECT *, sum(CASE WHEN length(piece) >= 1000 THEN 1 ELSE 0 END)
                OVER (PARTITION BY {part} ORDER BY i) AS run
              FROM {source})
        WHERE length(piece) < 1000)
  GROUP BY {part}, run)"""


# chunks(chunk_id, doc_id, page, chunk_no, text, lang, source); needs WITH RECURSIVE.
CHUNKS = (
    DOCS
    + ","
    + _pieces("p1", "docs", "", "\n\n")
    + ","
    + _pieces(
        "p2",
        "(SELECT doc_id, i AS i1, piece AS text FROM p1 WHERE length(piece) >= 1000)",
        "i1, ",
        "\n",
    )
    + ","
    + _pieces(
        "p3",
        "(SELECT doc_id, i1, i AS i2, piece AS text FROM p2 WHERE length(piece) >= 1000)",
        "i1, i2, ",
        " ",
    )
    + ","
    + _runs("r1", "p1", "", "min(i)", "0", "0")
    + ","
    + _runs("r2", "p2", "i1", "i1", "min(i)", "0")
    + ","
    + _runs("r3", "p3", "i1, i2", "i1", "i2", "min(i)")
    + f""",
runs AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3),
walk AS (
  SELECT doc_id, o1, o2, o3, pieces, cs, 1::BIGINT AS step, 1::BIGINT AS s,
         len(list_filter(cs, lambda c: c <= 1000))::BIGINT AS e
  FROM runs
  UNION ALL
  SELECT doc_id, o1, o2, o3, pieces, cs, step + 1, s2 + 1,
         len(list_filter(cs, lambda c: c <= 1000 + CASE WHEN s2 = 0 THEN 0 ELSE cs[s2] END))::BIGINT
  FROM (SELECT *, len(list_filter(list_prepend(0::BIGINT, cs),
                    lambda c: c < greatest(cs[e] - 200, cs[e + 1] - 1000)))::BIGINT AS s2
        FROM walk WHERE e < len(cs))),
cut AS (
  SELECT doc_id, o1, o2, o3, step, array_to_string(pieces[s:e], '') AS text FROM walk
  UNION ALL
  SELECT doc_id, i1, i2, i, w, substr(piece, w * 800 + 1, 1000)
  FROM (SELECT *, unnest(range(0, 1 + greatest(0, ceil((length(piece) - 1000) / 800.0))::BIGINT)) AS w
        FROM p3 WHERE length(piece) >= 1000)),
chunks AS (
  SELECT struct_pack(doc_id := c.doc_id, page := 0::BIGINT, chunk_no := c.chunk_no) AS chunk_id,
    c.doc_id, 0::BIGINT AS page, c.chunk_no, c.text, d.lang, d.source
  FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2, o3, step) - 1 AS chunk_no
        FROM (SELECT * REPLACE (trim(text, {STRIP}) AS text) FROM cut) WHERE text <> '') c
  JOIN documents d USING (doc_id))"""
)


def entries(name: str, source: str, key: str, text: str = "text") -> str:
    """Long form of the hashed vectors of a table of texts."""
    return f"""
{name} AS (
  SELECT {key}, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT {key}, (('0x' || substr(md5(w), 1, 8))::BIGINT % {HASH_DIM})::BIGINT AS bucket, count(*)::DOUBLE AS c
        FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source})
        GROUP BY 1, 2))"""


def sparse_hits(name: str, questions: str, key: str = "query_id") -> str:
    """Nearest 20 by rounded distance over hashed vectors: {name}(query_id, item_id, rank, s)."""
    return f"""
{name} AS (
  SELECT query_id, item_id, rank, s FROM (
    SELECT query_id, item_id, round(dot, 6) AS s,
           row_number() OVER (PARTITION BY query_id ORDER BY round(2 - 2 * dot, 6), item_id) AS rank
    FROM (SELECT a.query_id, i.item_id, coalesce(dot, 0) AS dot
          FROM (SELECT DISTINCT {key} AS query_id FROM {questions}) a
          CROSS JOIN (SELECT DISTINCT chunk_id AS item_id FROM chunk_entries) i
          LEFT JOIN (SELECT q.{key} AS query_id, c.chunk_id AS item_id, sum(q.weight * c.weight) AS dot
                     FROM {questions} q JOIN chunk_entries c USING (bucket) GROUP BY 1, 2) d
            ON d.query_id = a.query_id AND d.item_id = i.item_id))
  WHERE rank <= 20)"""


def sparse_pairs(hits: str) -> str:
    return f"""
pairs AS (
  SELECT a.query_id, a.item_id AS a, b.item_id AS b, round(coalesce(p.dot, 0), 6) AS sim
  FROM {hits} a JOIN {hits} b USING (query_id)
  LEFT JOIN (SELECT x.chunk_id AS a, y.chunk_id AS b, sum(x.weight * y.weight) AS dot
             FROM (SELECT DISTINCT u.item_id AS a, v.item_id AS b FROM {hits} u JOIN {hits} v USING (query_id)) w
             JOIN chunk_entries x ON x.chunk_id = w.a
             JOIN chunk_entries y ON y.chunk_id = w.b AND y.bucket = x.bucket
             GROUP BY 1, 2) p ON p.a = a.item_id AND p.b = b.item_id)"""


def picks(hits: str, k: int = 5) -> str:
    """Greedy diversity picks over ``hits`` and ``pairs``: picked{k}(query_id, item_id, pick)."""
    parts = [
        f"""
picked1 AS (SELECT query_id, item_id, 1::BIGINT AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rn FROM {hits}) WHERE rn = 1)"""
    ]
    for n in range(2, k + 1):
        parts.append(
            f"""
picked{n} AS (
  SELECT * FROM picked{n - 1}
  UNION ALL
  SELECT query_id, item_id, {n}::BIGINT FROM (
    SELECT c.query_id, c.item_id, row_number() OVER (
        PARTITION BY c.query_id
        ORDER BY 0.5::DOUBLE * c.s - 0.5::DOUBLE * m.worst DESC, c.rank) AS rn
    FROM {hits} c
    JOIN (SELECT pr.query_id, pr.a, max(pr.sim) AS worst FROM pairs pr
          JOIN picked{n - 1} p ON p.query_id = pr.query_id AND p.item_id = pr.b GROUP BY 1, 2) m
      ON m.query_id = c.query_id AND m.a = c.item_id
    WHERE NOT EXISTS (SELECT 1 FROM picked{n - 1} p
                      WHERE p.query_id = c.query_id AND p.item_id = c.item_id)) WHERE rn = 1)"""
        )
    return ",".join(parts)


DENSE_HITS = """
dist AS (
  SELECT q.vec_id AS query_id, c.vec_id AS item_id,
         list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) ** 2 AS d,
         list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS cos
  FROM embeddings q, embeddings c),
hits AS (
  SELECT query_id, item_id, rank, round(d, 6) AS distance, round(cos, 6) AS s FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), item_id) AS rank FROM dist)
  WHERE rank <= 20)"""

# The first sqrt(n) vectors by md5 of their id are pivots; a query looks into its 8 nearest cells.


# As many cells as hold 0.9 of the exact hits (less two standard errors) of 256 queries.
CALIBRATED = """
pivots AS (
  SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cell, embedding AS centre FROM embeddings
  QUALIFY cell < ceil(sqrt((SELECT count(*) FROM embeddings)))),
reach AS (
  SELECT vec_id, cell, round(list_distance(embedding::DOUBLE[], centre::DOUBLE[]) ** 2, 6) AS d FROM embeddings, pivots),
placed AS (SELECT vec_id, cell FROM reach QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) = 1),
places AS (
  SELECT vec_id AS query_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY d, cell) AS place FROM reach
  WHERE cell IN (SELECT cell FROM placed)),
asked AS (SELECT vec_id AS query_id FROM embeddings ORDER BY md5('query ' || vec_id::VARCHAR), vec_id LIMIT 256),
found AS (
  SELECT h.query_id, o.place FROM hits h JOIN asked USING (query_id) JOIN placed p ON p.vec_id = h.item_id
  JOIN places o ON o.query_id = h.query_id AND o.cell = p.cell),
shares AS (
  SELECT n.p, query_id, avg((place <= n.p)::INT) AS share FROM found, (SELECT DISTINCT place AS p FROM places) n GROUP BY ALL),
enough AS (
  SELECT min(p) AS p FROM (SELECT p, avg(share) - 2 * stddev_pop(share) / sqrt(count(*)) AS low FROM shares GROUP BY p)
  WHERE round(low, 9) >= 0.9),
calibrated AS (
  SELECT query_id, item_id, rank, round(d, 6) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), item_id) AS rank FROM (
      SELECT l.query_id, p.vec_id AS item_id, list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) ** 2 AS d
      FROM places l JOIN enough ON l.place <= enough.p JOIN placed p USING (cell)
      JOIN embeddings q ON q.vec_id = l.query_id JOIN embeddings c ON c.vec_id = p.vec_id))
  WHERE rank <= 20)"""

DENSE_PAIRS = """
pairs AS (
  SELECT a.query_id, a.item_id AS a, b.item_id AS b,
         round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS sim
  FROM hits a JOIN hits b USING (query_id)
  JOIN embeddings x ON x.vec_id = a.item_id JOIN embeddings y ON y.vec_id = b.item_id)"""

# ---- requests and FAQ --------------------------------------------------------

REQUESTS = """
requests AS (
  SELECT doc_id,
    CASE WHEN doc_id % 11 <> 0 THEN text END AS question,
    CASE WHEN doc_id % 3 = 0 THEN 'lawyer' ELSE 'normal' END AS character,
    CASE WHEN doc_id % 7 = 0 THEN 50 ELSE doc_id % 101 END::DOUBLE AS tone,
    CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'comic' WHEN 2 THEN 'poster' END AS illustration
  FROM documents)"""


def faq_position(question: str) -> str:
    tests = " ".join(
        f"WHEN contains(lower({question}), {quote(e.keyword)}) THEN {i}" for i, e in enumerate(FAQ)
    )
    return f"CASE {tests} ELSE {len(FAQ)} END"


FAQ_TABLE = "faq AS (SELECT * FROM (VALUES {}) AS f(faq_no, keyword, lt, nt, lc, lp, nc, np))".format(
    ", ".join(
        "({})".format(
            ", ".join(
                [
                    str(i),
                    *map(
                        quote,
                        (
                            e.keyword,
                            e.lawyer_text,
                            e.normal_text,
                            e.lawyer_comic,
                            e.lawyer_poster,
                            e.normal_comic,
                            e.normal_poster,
                        ),
                    ),
                ]
            )
        )
        for i, e in enumerate([*FAQ, FAQ_DEFAULT])
    )
)


def route_case(text: str) -> str:
    tests = " ".join(
        f"WHEN regexp_matches(lower({text}), {quote(p)}) THEN {quote(label)}" for label, p in ROUTE_RULES
    )
    return f"CASE {tests} ELSE 'direct' END"


# ---- sessions ------------------------------------------------------------------

SESSION_ID = "(user_id * 10 + (day(ts) - 1) // 7)::BIGINT"
K = "(props::JSON ->> 'k')::BIGINT"

SESSION_LOG = f"""
session_log AS (
  SELECT {SESSION_ID} AS session_id, user_id, event_id, ts,
    ((((day(ts) - 1) % 7) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 864)::BIGINT AS offset_s,
    CASE WHEN value > 200 THEN 'end' WHEN event_type = 'click' THEN 'user_message'
         WHEN event_type = 'view' THEN 'opponent_message' WHEN event_type = 'error' THEN 'objection'
         WHEN event_type = 'purchase' THEN 'evidence' ELSE 'pause' END AS kind,
    {K} AS k
  FROM events)"""

SETTINGS = f"""
settings AS (
  SELECT session_id, user_id,
    [5, 10, 15, 20, 10][(session_id % 5) + 1]::BIGINT AS time_limit_min,
    [2, 3, 5, 3][(session_id % 4) + 1]::BIGINT AS objection_limit,
    session_id % 2 = 0 AS pause_enabled,
    CASE WHEN session_id % 3 = 0 THEN 'plaintiff' ELSE 'defendant' END AS role
  FROM (SELECT DISTINCT {SESSION_ID} AS session_id, user_id FROM events))"""

PAUSES = """
presses AS (SELECT DISTINCT session_id, offset_s FROM session_log JOIN settings USING (session_id)
            WHERE kind = 'pause' AND pause_enabled),
a1 AS (SELECT session_id, min(offset_s) AS t FROM presses GROUP BY 1),
a2 AS (SELECT p.session_id, min(offset_s) AS t FROM presses p JOIN a1 USING (session_id)
       WHERE offset_s >= a1.t + 10 GROUP BY 1),
a3 AS (SELECT p.session_id, min(offset_s) AS t FROM presses p JOIN a2 USING (session_id)
       WHERE offset_s >= a2.t + 10 GROUP BY 1)"""

REMAINING = """
remaining AS (
  SELECT session_id, time_limit_min * 60 AS limit_s, elapsed_s, pauses,
         greatest(0, time_limit_min * 60 - elapsed_s + 10 * pauses)::BIGINT AS time_remaining
  FROM (SELECT s.session_id, s.time_limit_min, max(offset_s) - min(offset_s) AS elapsed_s,
               (any_value(a1.t) IS NOT NULL)::BIGINT + (any_value(a2.t) IS NOT NULL)::BIGINT
                 + (any_value(a3.t) IS NOT NULL)::BIGINT AS pauses
        FROM session_log l JOIN settings s USING (session_id)
        LEFT JOIN a1 ON a1.session_id = l.session_id
        LEFT JOIN a2 ON a2.session_id = l.session_id
        LEFT JOIN a3 ON a3.session_id = l.session_id
        GROUP BY 1, 2))"""

ARGUMENTS = f"""
edits AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY offset_s, event_id) AS n FROM (
    SELECT session_id, offset_s, event_id, k % 3 + 1 AS arg_id, 'v' || event_id AS txt,
      CASE kind WHEN 'evidence' THEN 'add' WHEN 'opponent_message' THEN 'replace'
                WHEN 'objection' THEN 'remove' END AS op
    FROM session_log) WHERE op IS NOT NULL),
states AS (
  SELECT session_id, 0::BIGINT AS n,
         [{{'id': 1::BIGINT, 'at': -1::BIGINT, 'by': -1::BIGINT, 'txt': ''}}] AS items
  FROM settings
  UNION ALL
  SELECT s.session_id, e.n,
    CASE e.op
      WHEN 'add' THEN list_append(s.items, {{'id': e.arg_id, 'at': e.offset_s, 'by': e.event_id, 'txt': ''}})
      WHEN 'replace' THEN list_transform(s.items, lambda x: {{'id': x.id, 'at': x.at, 'by': x.by,
          'txt': CASE WHEN x.id = e.arg_id THEN e.txt ELSE x.txt END}})
      ELSE CASE WHEN len(s.items) > 1 THEN list_filter(s.items, lambda x: x.id <> e.arg_id) ELSE s.items END
    END
  FROM states s JOIN edits e ON e.session_id = s.session_id AND e.n = s.n + 1),
arguments AS (
  SELECT session_id, x.id AS arg_id, x.at AS added_s, x.by AS added_by, x.txt AS text
  FROM (SELECT session_id, unnest(items) AS x FROM states s
        WHERE n = (SELECT coalesce(max(n), 0) FROM edits e WHERE e.session_id = s.session_id)))"""

LINKS = f"""
links AS (
  SELECT session_id, evidence_id, argument_id FROM (
    SELECT {SESSION_ID} AS session_id, event_type AS evidence_id, {K} % 4 + 1 AS argument_id FROM events)
  GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _bucket(name: str, span: int) -> str:
    return f"(('0x' || substr(md5(session_id || '{name}'), 1, 8))::BIGINT % {span})"


SCORES = f"""
scored AS (
  SELECT *, legal_accuracy + evidence_use + persuasion + time_management + etiquette AS total FROM (
    SELECT session_id, user_id, 60 + {_bucket('legal', 30)} AS legal_accuracy,
      60 + {_bucket('evidence', 30)} + CASE WHEN evidence_count > 1 THEN 15 ELSE 0 END AS evidence_use,
      60 + {_bucket('persuasion', 30)} + CASE WHEN argument_count > 2 THEN 10 ELSE 0 END AS persuasion,
      CASE WHEN time_remaining > 0 THEN 80 + time_remaining // 10 ELSE 50 END AS time_management,
      75 + {_bucket('etiquette', 20)} AS etiquette
    FROM settings JOIN remaining USING (session_id)
    JOIN (SELECT session_id, count(*) FILTER (kind = 'user_message') AS argument_count,
                 count(*) FILTER (kind = 'evidence') AS evidence_count
          FROM session_log GROUP BY 1) USING (session_id)))"""

EARNED = "earned AS (SELECT user_id, [{}][{} % (user_id % {} + 1) + 1] AS badge_id, ts FROM events)".format(
    ", ".join(quote(b[0]) for b in BADGES), K, len(BADGES)
)
TALLY = (
    EARNED
    + ", tally AS (SELECT user_id, badge_id, count(*) AS cnt, max(ts) AS last_earned FROM earned GROUP BY 1, 2)"
)

WINS = """
played AS (SELECT user_id, ts, event_id, value > 20 AS won,
             CASE WHEN event_id % 3 = 0 THEN 'plaintiff' ELSE 'defendant' END AS role FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM played),
won_runs AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
             FROM numbered WHERE won)"""
