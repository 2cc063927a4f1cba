"""Registered queries over whole books and chapters, and SQL for them: documents as texts of books, with catalogs made of their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPACE_SQL, lines
from ..operators import books
from ..operators.segment import FRONT
from .tables import table

#: Lines of at most three words that end in a full stop stand for headings.
SHORT_LINE = r"\A[^ ]+(?: [^ ]+){0,2}\.\z"
MARKER = "------章节内容开始-------"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose headings and every fifth line stand at the margin; every second one has something before its marker."""
    own = F.transform(lines(F.col("text")), lambda x, k: F.when(x.rlike(SHORT_LINE) | (k % 5 == 4), x).otherwise(F.concat(F.lit("　　"), x)))
    front = F.when(F.col("doc_id") % 2 == 0, F.lit(f"『x』\nfront.\n{MARKER}\n")).otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.concat(front, F.array_join(own, "\n")).alias("text"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings in order, every fourth replaced by one that the text lacks; of every third book another one's."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "line")).filter(F.col("line").rlike(SHORT_LINE))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    title = F.when((F.col("doc_id") % 3 == 0) | (F.col("index") % 4 == 3), F.concat(F.lit("gone "), F.col("index").cast("string"))).otherwise(F.replace("line", F.lit(" "), F.lit("  ")))
    return each.withColumn("index", k).select(F.col("doc_id").alias("book_id"), "index", (F.col("index") + 1000).cast("string").alias("id"), title.alias("title"))


def whole_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, _ = books.whole_books(_texts(spark, sf_dir), _catalog(spark, sf_dir))
    return found.select("book_id", F.col("chapter").cast("long").alias("chapter"), "chapter_id", "title", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.md5(F.array_join("paragraphs", "\n").cast("binary")).alias("digest"))


def whole_book_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, _ = books.whole_books(_texts(spark, sf_dir), _catalog(spark, sf_dir))
    return found.select("book_id", *[F.col(c).cast("long").alias(c) for c in ("matched", "headings", "chapters")], "aligned")


def whole_book_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.whole_books(_texts(spark, sf_dir), _catalog(spark, sf_dir))[2]


_BOOKS_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, pos, line, regexp_matches(line, '{SHORT_LINE}') AS h FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
    FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents))
), k AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place, line, (NOT h AND pos % 5 <> 4) OR regexp_matches(raw, '\A[ \t　]') AS inset
  FROM (SELECT doc_id, pos, h, line AS raw, regexp_replace(line, '\A[{SPACE_SQL}]+|[{SPACE_SQL}]+\z', '', 'g') AS line FROM l) WHERE line <> ''
), c AS (
  SELECT doc_id, i, CAST(i + 1000 AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 OR i % 4 = 3 THEN 'gone ' || i ELSE replace(line, ' ', '  ') END AS title
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM l WHERE h)
), p AS (SELECT doc_id, regexp_replace(title, '[{SPACE_SQL}]+', '', 'g') AS key, list(i) AS places FROM c GROUP BY ALL),
m AS (
  SELECT k.doc_id, k.place, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.place) AS n, coalesce(p.places, []) AS places
  FROM k LEFT JOIN p ON p.doc_id = k.doc_id AND p.key = regexp_replace(k.line, '[{SPACE_SQL}]+', '', 'g') WHERE NOT k.inset
), g AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS i, CAST(0 AS BIGINT) AS after FROM documents
  UNION ALL SELECT doc_id, n, place, i, coalesce(i + 1, after) FROM (
    SELECT m.doc_id, m.n, m.place, list_min(list_filter(m.places, lambda x: x >= g.after AND x <= g.after + 200)) AS i, g.after FROM g JOIN m ON m.doc_id = g.doc_id AND m.n = g.n + 1)
), b AS (
  SELECT d.doc_id, coalesce(x.matched, 0) AS matched, coalesce(y.headings, 0) AS headings, coalesce(x.matched, 0) > 0 AND x.matched * 2 >= coalesce(y.headings, 0) AS aligned FROM documents d
  LEFT JOIN (SELECT doc_id, count(i) AS matched FROM g GROUP BY doc_id) x USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS headings FROM k WHERE NOT inset GROUP BY doc_id) y USING (doc_id)
), s AS (
  SELECT k.doc_id, k.place, k.line, b.aligned, CASE WHEN b.aligned THEN c.id END AS id, CASE WHEN b.aligned THEN c.title WHEN NOT k.inset AND length(k.line) <= 40 THEN k.line END AS title
  FROM k JOIN b USING (doc_id) LEFT JOIN g ON g.doc_id = k.doc_id AND g.place = k.place AND g.i IS NOT NULL LEFT JOIN c ON c.doc_id = g.doc_id AND c.i = g.i
), o AS (SELECT *, count(title) OVER (PARTITION BY doc_id ORDER BY place) AS part FROM s),
f AS (
  SELECT doc_id, part, coalesce(max(title), '{FRONT}') AS title, max(id) AS id, count(*) FILTER (title IS NULL) AS n_paragraphs, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (title IS NULL), '') AS body
  FROM o WHERE part > 0 OR NOT aligned GROUP BY doc_id, part
), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS chapter FROM f)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (whole_books, whole_book_fits, whole_book_gaps)}


def oracle_sql() -> dict[str, str]:
    return {
        "whole_books": f"{_BOOKS_SQL} SELECT doc_id AS book_id, chapter, coalesce(id, CAST(chapter AS VARCHAR)) AS chapter_id, title, n_paragraphs, md5(body) AS digest FROM q",
        "whole_book_fits": f"{_BOOKS_SQL} SELECT b.doc_id AS book_id, matched, headings, coalesce(n, 0) AS chapters, aligned FROM b LEFT JOIN (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id) USING (doc_id)",
        "whole_book_gaps": f"{_BOOKS_SQL} SELECT c.doc_id AS book_id, CAST(c.i AS INTEGER) AS index, c.id, c.title FROM c JOIN b USING (doc_id) WHERE b.aligned AND NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = c.doc_id AND g.i = c.i)",
    }
