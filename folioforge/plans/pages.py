"""Registered queries over markup, fetched pages of chapters and JSON records, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, text
from ..functions.dialect import lines
from ..operators import chapters
from ..sources import repair
from .tables import table


def _digest(column: Column) -> Column:
    return F.md5(column.cast("binary"))


def decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with some letters as numbers besides the entities that they have."""
    own = F.replace(F.replace(F.replace("html", F.lit(" de "), F.lit(" &#100;&#x65;&#1114112; ")), F.lit("ñ"), F.lit("&#xF1;")), F.lit("ü"), F.lit("&#128512;"))
    return table(spark, sf_dir, "pages").select("page_id", _digest(text.decode_entities(own)).alias("digest"))


_ENTITIES = (("&quot;", '"'), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "''"), ("&nbsp;", " "), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))


def _decoded_sql() -> str:
    """Numbers stand for the letters that they replaced; the ampersand comes last, so that nothing is decoded twice."""
    own = "replace(replace(replace(html, ' de ', ' de&#1114112; '), 'ü', '😀'), 'ñ', 'ñ')"
    for name, char in _ENTITIES:
        own = f"replace({own}, '{name}', '{char}')"
    return f"SELECT page_id, md5({own}) AS digest FROM pages"


def _nested(html: Column) -> Column:
    """Articles as divs that hold a div for each paragraph."""
    own = F.replace(F.replace(html, F.lit("<article>"), F.lit('<DIV id="own" class="a body">')), F.lit("</article>"), F.lit("</DIV>"))
    return F.replace(F.replace(own, F.lit("<p>"), F.lit("<div><p>")), F.lit("</p>"), F.lit("</p></div>"))


def nested_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the article holds, and the page without advertising."""
    own = _nested(F.col("html"))
    inner, rest = markup.div_inner(own, "class", "body"), markup.without_divs(own, r"\bad\b")
    return table(spark, sf_dir, "pages").select("page_id", _digest(inner).alias("inner_digest"), _digest(rest).alias("rest_digest"))


_NESTED_SQL = r"""
WITH p AS (
  SELECT page_id, replace(replace(replace(replace(html, '<article>', '<DIV id="own" class="a body">'), '</article>', '</DIV>'), '<p>', '<div><p>'), '</p>', '</p></div>') AS h FROM pages
), a AS (SELECT page_id, regexp_extract_all(h, '(?i)</?div\b[^>]*>') AS tags, string_split_regex(h, '(?i)</?div\b[^>]*>') AS gaps FROM p),
t AS (SELECT page_id, k, tags[k] AS tag, gaps[k + 1] AS gap, CASE WHEN tags[k] LIKE '</%' THEN -1 ELSE 1 END AS s FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS k FROM a)),
d AS (SELECT *, sum(s) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM t),
o AS (SELECT page_id, min(k) AS k FROM d WHERE s = 1 AND regexp_matches(tag, '(?i)\bclass\s*=\s*["''][^"'']*\bbody\b') GROUP BY page_id),
e AS (SELECT o.page_id, o.k, coalesce(min(z.k), 1000000000) AS e FROM o JOIN d ON d.page_id = o.page_id AND d.k = o.k LEFT JOIN d z ON z.page_id = o.page_id AND z.k > o.k AND z.depth = d.depth - 1 GROUP BY ALL),
i AS (SELECT d.page_id, string_agg(CASE WHEN d.k > e.k THEN tag ELSE '' END || gap, '' ORDER BY d.k) AS own FROM d JOIN e ON e.page_id = d.page_id AND d.k >= e.k AND d.k < e.e GROUP BY d.page_id),
g AS (SELECT m.page_id, m.k, coalesce(min(z.k), 1000000000) AS e FROM d m LEFT JOIN d z ON z.page_id = m.page_id AND z.k > m.k AND z.depth = m.depth - 1 WHERE m.s = 1 AND regexp_matches(m.tag, '(?i)\bad\b') GROUP BY m.page_id, m.k),
r AS (SELECT d.page_id, d.k, CASE WHEN g.k = d.k THEN ' ' WHEN g.k IS NOT NULL THEN '' ELSE d.tag END || CASE WHEN g.k IS NULL OR g.e = d.k THEN d.gap ELSE '' END AS own FROM d LEFT JOIN g ON g.page_id = d.page_id AND d.k BETWEEN g.k AND g.e)
SELECT a.page_id, md5(i.own) AS inner_digest, md5(a.gaps[1] || coalesce(x.rest, '')) AS rest_digest FROM a LEFT JOIN i USING (page_id) LEFT JOIN (SELECT page_id, string_agg(own, '' ORDER BY k) AS rest FROM r GROUP BY page_id) x USING (page_id)
"""


def _chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines a page. Some pages lack the link to the next one, some have failed; every third chapter has an answer that nothing follows, every second says
    which chapter follows, and every seventh comes back to its first page at the end."""
    own = table(spark, sf_dir, "documents").withColumn("l", lines(F.col("text")))
    n = F.ceil(F.size("l") / 3).cast("int")
    own = own.withColumn("n", n).select("doc_id", "l", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    d, k = F.col("doc_id"), F.col("k")
    beyond = k == F.col("n")
    looped = (d % 7 == 0) & beyond & (F.col("n") > 1)
    gone = beyond & (d % 3 == 0) & ~looped
    own = own.filter(~beyond | looped | gone)
    body = F.when(looped, F.slice("l", F.lit(1), F.lit(3))).when(gone, F.array().cast("array<string>")).otherwise(F.slice("l", F.col("k") * 3 + 1, F.lit(3)))
    outcome = F.when(gone, "not_found").when((d * 3 + k) % 17 == 0, "failed").otherwise("ok")
    links = F.when((d + k) % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(k + 1))
    last = F.when((k == F.col("n") - 1) & (d % 2 == 0), F.concat(F.lit("c"), d.cast("string")))
    return own.select(d.cast("string").alias("book_id"), F.lit("1").alias("chapter_id"), k.alias("page_index"), outcome.alias("outcome"), F.concat(F.lit("t"), k.cast("string")).alias("title"), body.alias("paragraphs"), F.when(k == 0, "before").alias("prev_id"), last.alias("next_id"), links.alias("same_pages"), F.lit(None).cast("int").alias("declared_page"), (k == 3).alias("restricted"))


def assembled_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chapters.assemble(_chapter_pages(spark, sf_dir))
    missing = F.array_join(F.transform("missing", lambda x: x.cast("string")), ",")
    return found.select("book_id", "title", _digest(F.array_join("paragraphs", "\n")).alias("digest"), "prev_id", "next_id", F.col("page_count").cast("long").alias("page_count"), "char_count", "complete", missing.alias("missing"), "restricted")


#: Visits go along the links, which lead from a page to the next, to the first page without a link or without text; one probe goes on behind that.
_ASSEMBLED_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, l, CAST(ceil(len(l) / 3.0) AS BIGINT) AS n FROM l),
r AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n),
q AS (SELECT *, k = n AND doc_id % 7 = 0 AND n > 1 AS looped, k = n AND doc_id % 3 = 0 AND NOT (doc_id % 7 = 0 AND n > 1) AS gone FROM r),
p AS (
  SELECT doc_id, k, CASE WHEN looped THEN l[1:3] ELSE l[k * 3 + 1:k * 3 + 3] END AS body, CASE WHEN gone THEN 'not_found' WHEN (doc_id * 3 + k) % 17 = 0 THEN 'failed' ELSE 'ok' END AS outcome,
    (doc_id + k) % 5 > 0 AS linked, CASE WHEN k = n - 1 AND doc_id % 2 = 0 THEN 'c' || doc_id END AS next_id
  FROM q WHERE k < n OR looped OR gone
), x AS (
  -- k is visited; phase 1 is the probe and what it leads to.
  SELECT doc_id, CAST(0 AS BIGINT) AS k FROM documents
  UNION ALL SELECT x.doc_id, x.k + 1 FROM x JOIN p ON p.doc_id = x.doc_id AND p.k = x.k WHERE p.outcome = 'ok' AND p.linked AND x.k < 39
), a AS (
  SELECT x.doc_id, x.k, p.next_id, p.body, p.outcome, CASE WHEN p.outcome = 'not_found' THEN 'absent' WHEN p.outcome IS NULL OR p.outcome = 'failed' THEN 'failed'
    WHEN row_number() OVER (PARTITION BY x.doc_id, p.body, p.outcome = 'ok' ORDER BY x.k) > 1 THEN 'absent' ELSE 'text' END AS kind FROM x LEFT JOIN p ON p.doc_id = x.doc_id AND p.k = x.k
), f AS (
  SELECT doc_id, max(k) AS reached, max(k) FILTER (kind = 'text') AS last, arg_max(next_id, k) FILTER (kind = 'text') AS unused FROM a GROUP BY doc_id
), e AS (
  SELECT f.doc_id, f.reached, f.last, f.last IS NOT NULL AND ((t.next_id IS NOT NULL AND f.last > 0) OR coalesce(u.kind = 'absent', false)) AS proved
  FROM f LEFT JOIN a t ON t.doc_id = f.doc_id AND t.k = f.last LEFT JOIN a u ON u.doc_id = f.doc_id AND u.k = f.last + 1
), y AS (
  SELECT doc_id, reached + 1 AS k FROM e WHERE last IS NOT NULL AND NOT proved AND reached + 1 < 40
  UNION ALL SELECT y.doc_id, y.k + 1 FROM y JOIN p ON p.doc_id = y.doc_id AND p.k = y.k WHERE p.outcome = 'ok' AND p.linked AND y.k < 39
), v AS (SELECT doc_id, k FROM x UNION ALL SELECT doc_id, k FROM y),
b AS (
  SELECT v.doc_id, v.k, p.next_id, p.body, CASE WHEN p.outcome = 'not_found' THEN 'absent' WHEN p.outcome IS NULL OR p.outcome = 'failed' THEN 'failed'
    WHEN row_number() OVER (PARTITION BY v.doc_id, p.body, p.outcome = 'ok' ORDER BY v.k) > 1 THEN 'absent' ELSE 'text' END AS kind FROM v LEFT JOIN p ON p.doc_id = v.doc_id AND p.k = v.k
), g AS (
  SELECT doc_id, max(k) FILTER (kind = 'text') AS last, min(k) FILTER (kind = 'text') AS first, count(*) FILTER (kind = 'text') AS pages, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (kind = 'failed') AS missing, bool_or(kind = 'text' AND k = 3) AS restricted FROM b GROUP BY doc_id
), h AS (
  SELECT g.*, t.next_id AS last_next, s.next_id AS first_next, (t.next_id IS NOT NULL AND g.last > 0) OR coalesce(u.kind = 'absent', false) AS ended FROM g
  LEFT JOIN b t ON t.doc_id = g.doc_id AND t.k = g.last LEFT JOIN b s ON s.doc_id = g.doc_id AND s.k = g.first LEFT JOIN b u ON u.doc_id = g.doc_id AND u.k = g.last + 1
), c AS (SELECT doc_id, k, j, body[j] AS line FROM (SELECT *, unnest(range(1, len(body) + 1)) AS j FROM b WHERE kind = 'text')),
w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY k, j) AS before FROM c),
o AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k, j) AS whole, sum(length(line)) AS chars FROM w WHERE j > 1 OR line IS DISTINCT FROM before GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS book_id, CASE WHEN h.last IS NOT NULL THEN 't' || h.first END AS title, md5(coalesce(o.whole, '')) AS digest, CASE WHEN h.first = 0 THEN 'before' END AS prev_id,
  coalesce(h.last_next, h.first_next) AS next_id, coalesce(h.pages, 0) AS page_count, CAST(coalesce(o.chars, 0) AS BIGINT) AS char_count, h.last IS NOT NULL AND h.ended AND h.missing IS NULL AS complete, coalesce(h.missing, '') AS missing, coalesce(h.restricted, false) AS restricted
FROM documents d JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)
"""


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    title = F.when(e % 4 == 1, F.concat(F.lit('"'), F.repeat(F.lit("t"), 130), F.lit('"'))).otherwise(F.concat(F.lit('"t'), e.cast("string"), F.lit('"')))
    size = F.element_at(F.array(*map(F.lit, ('"12"', "3", "99.7", "16.5", "20", "null"))), (e % 6 + 1).cast("int"))
    gap = F.element_at(F.array(*map(F.lit, ("-1", "0.25", "{}"))), (e % 3 + 1).cast("int"))
    dark = F.element_at(F.array(*map(F.lit, ("true", '"true"', "false", "1"))), (e % 4 + 1).cast("int"))
    theme = F.element_at(F.array(*map(F.lit, ('"paper"', '"neon"', "7", '""'))), (F.floor(e / 3) % 4 + 1).cast("int"))
    number = F.element_at(F.array(*map(F.lit, ('"12"', '"12a"', '"1234567890123"', "12"))), (F.floor(e / 5) % 4 + 1).cast("int"))
    parts = [F.lit('{"size": '), size, F.lit(', "gap": '), gap, F.lit(', "dark": '), dark, F.lit(', "theme": '), theme, F.lit(', "first": '), number, F.when(e % 4 > 0, F.concat(F.lit(', "title": '), title)).otherwise(""), F.lit("}")]
    return table(spark, sf_dir, "events").select("event_id", F.when(e % 11 == 0, "[1]").when(e % 13 == 0, '{"size": ').otherwise(F.concat(*parts)).alias("json"))


def repaired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = (
        repair.Field("title", required=True, filled=True, longest=100),
        repair.Field("size", "long", 18, least=14, most=28),
        repair.Field("gap", "double", 0.5, least=0, most=1.5),
        repair.Field("dark", "boolean", False),
        repair.Field("theme", default="light", choices=("light", "paper")),
        repair.Field("first", pattern=r"\A[0-9]{1,12}\z"),
    )
    return _json(spark, sf_dir).withColumn("r", repair.repaired(F.col("json"), fields)).filter("r is not null").select("event_id", "r.*")


_JSON_SQL = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '[1]' WHEN event_id % 13 = 0 THEN '{"size": ' ELSE '{"size": ' || (['"12"', '3', '99.7', '16.5', '20', 'null'])[event_id % 6 + 1] || ', "gap": ' || (['-1', '0.25', '{}'])[event_id % 3 + 1]
  || ', "dark": ' || (['true', '"true"', 'false', '1'])[event_id % 4 + 1] || ', "theme": ' || (['"paper"', '"neon"', '7', '""'])[event_id // 3 % 4 + 1] || ', "first": ' || (['"12"', '"12a"', '"1234567890123"', '12'])[event_id // 5 % 4 + 1]
  || CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN ', "title": "' || repeat('t', 130) || '"' ELSE ', "title": "t' || event_id || '"' END || '}' END AS json FROM events"""

_REPAIRED_SQL = rf"""
WITH j AS (SELECT event_id, json, json_type(json, '$.title') AS tt, json_type(json, '$.size') AS st, json_type(json, '$.gap') AS gt, json_type(json, '$.dark') AS dt, json_type(json, '$.theme') AS ht, json_type(json, '$.first') AS ft FROM ({_JSON_SQL}) WHERE json_valid(json)),
s AS (SELECT *, CAST(json_extract_string(json, '$.size') AS DOUBLE) AS size, CASE WHEN gt <> 'OBJECT' THEN CAST(json_extract_string(json, '$.gap') AS DOUBLE) END AS gap, json_extract_string(json, '$.title') AS title, json_extract_string(json, '$.theme') AS theme, json_extract_string(json, '$.first') AS f FROM j)
SELECT event_id, left(title, 100) AS title, CAST(CASE WHEN st IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN least(28, greatest(14, floor(size + 0.5))) ELSE 18 END AS BIGINT) AS size, CASE WHEN gt IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN least(1.5, greatest(0.0, gap)) ELSE 0.5 END AS gap,
  CASE WHEN dt = 'BOOLEAN' THEN json_extract_string(json, '$.dark') = 'true' ELSE false END AS dark, CASE WHEN ht = 'VARCHAR' AND theme IN ('light', 'paper') THEN theme ELSE 'light' END AS theme, CASE WHEN ft = 'VARCHAR' AND regexp_matches(f, '\A[0-9]{{1,12}}\z') THEN f END AS first
FROM s WHERE tt = 'VARCHAR' AND title <> ''
"""


def json_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as strings within nested lists, with brackets and escaped quotes of their own."""
    e = F.col("doc_id")
    said = F.concat(F.lit('"[{ \\" '), F.regexp_replace(F.left("text", F.lit(50)), r'["\\]', ""), F.lit('"'))
    n = (e % 40).cast("int")
    own = F.concat(F.repeat(F.lit("["), n), said, F.repeat(F.lit("]"), n), F.lit("{}"))
    return table(spark, sf_dir, "documents").select("doc_id", repair.depth(own).alias("depth"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (decoded_entities, nested_elements, assembled_chapters, repaired_records, json_depth)}


def oracle_sql() -> dict[str, str]:
    return {
        "decoded_entities": _decoded_sql(),
        "nested_elements": _NESTED_SQL,
        "assembled_chapters": _ASSEMBLED_SQL,
        "repaired_records": _REPAIRED_SQL,
        "json_depth": r"""WITH t AS (SELECT doc_id, repeat('[', CAST(doc_id % 40 AS INT)) || '"[{ \" ' || regexp_replace(left(text, 50), '["\\]', '', 'g') || '"' || repeat(']', CAST(doc_id % 40 AS INT)) || '{}' AS j FROM documents),
            b AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(j, '(?s)\\.', '', 'g'), '"[^"]*"', '', 'g'), '[\[\]{}]') AS b FROM t),
            s AS (SELECT doc_id, k, CASE WHEN b[k] IN ('[', '{') THEN 1 ELSE -1 END AS s FROM (SELECT *, unnest(range(1, len(b) + 1)) AS k FROM b)),
            r AS (SELECT doc_id, sum(s) OVER (PARTITION BY doc_id ORDER BY k) AS d FROM s) SELECT doc_id, CAST(max(d) AS INTEGER) AS depth FROM r GROUP BY doc_id""",
    }
