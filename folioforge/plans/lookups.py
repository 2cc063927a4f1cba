"""Registered queries over lists of chapters and caches, and SQL for them: orders as entries of contents, documents as pages of chapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialect import SPACE_SQL, lines
from ..functions.families import Family
from ..operators import parse, search, statistics, stores
from .tables import NOW, table

SOUTH = Family("south", "south-", ("s.example.com",), (r"\A/book/([0-9]+)\.htm\z",), (r"\A/txt/([0-9]+)/([0-9]+)\z",), "https://s.example.com/book/{book}.htm", "https://s.example.com/txt/{book}/{chapter}")


def _entries(spark: SparkSession, sf_dir: str, books: int) -> DataFrame:
    """Orders of so many books, with n, their number from 1, and page: the first pages are short, later ones long."""
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % books).alias("book"), "o_orderkey", "o_totalprice", "o_orderstatus")
    n = F.row_number().over(Window.partitionBy("book").orderBy("o_orderkey"))
    return own.withColumn("n", n).withColumn("page", (F.floor(F.sqrt(F.col("n") - 1)) + 1).cast("int"))


def _entries_sql(books: int) -> str:
    return f"SELECT *, CAST(floor(sqrt(n - 1)) + 1 AS INTEGER) AS page FROM (SELECT o_custkey % {books} AS book, o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey % {books} ORDER BY o_orderkey) AS n FROM orders)"


def other_source_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _entries(spark, sf_dir, 50)
    entries = own.select(F.col("book").alias("book_id"), "page", F.col("n").alias("pos"), F.col("o_orderkey").alias("id"), F.concat(F.lit("第 "), F.col("n").cast("string"), F.lit(" 章")).alias("title"), F.lit("x").alias("display_title"))
    wanted = own.filter("n % 7 = 1").select(F.col("book").alias("book_id"), F.concat(F.lit("第"), F.col("n").cast("string"), F.lit("章")).alias("title"))
    totals = own.groupBy(F.col("book").alias("book_id")).agg(F.max("page").alias("total_pages"))
    return search.in_other_source(wanted, entries, totals)


def cache_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages")
    kept = own.filter("page_id % 3 > 0").select(F.col("url").alias("key"), (F.lit(NOW) - F.col("page_id") * 1000).alias("at"), (F.col("page_id") % 5 * 60).alias("age"), F.length("html").alias("size"))
    cache = stores.with_max_age(kept, "at", F.col("age")).select("key", "expires", "size")
    cache = cache.unionByName(cache.withColumns({"expires": F.col("expires") - 10_000, "size": F.lit(-1)}))
    return stores.cache_read(own.select("page_id", F.col("url").alias("key")), cache, F.lit(NOW)).select("page_id", "hit", "expires", "size")


def beside_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("order_key"), F.col("turn").cast("string").alias("chapter_id")).distinct()
    stored = own.select("book_id", "chapter_id", F.concat(F.lit("p"), "chapter_id").alias("prev_id"), F.when(F.col("order_key") % 2 == 0, F.concat(F.lit("n"), "chapter_id")).alias("next_id"))
    return search.beside(stored, own.filter("order_key % 4 <> 3")).withColumn("index", F.col("index").cast("long"))


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey", parts.alias("x")))), lambda r: r["x"]), "")


def listed_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by price; of every third book some have no number, and of every sixth they stand alone as links."""
    own = _entries(spark, sf_dir, 200)
    number = F.when((F.col("book") % 3 == 0) & (F.col("n") % 2 == 0), F.lit("")).otherwise(F.concat(F.lit(' data-num="'), F.col("n").cast("string"), F.lit('"')))
    link = F.concat(F.lit('<a class=x href="/txt/'), F.col("book").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit('">t&amp; <b>'), F.col("o_orderstatus"), F.lit("</b></a>"))
    item = F.when(F.col("book") % 6 == 0, link).otherwise(F.concat(F.lit("<li"), number, F.lit(">"), link, F.lit("</li>")))
    pages = own.groupBy("book").agg(_joined(item).alias("x"))
    html = F.concat(F.lit('<a href="/txt/1/1">menu</a><div class="y" id="catalog"><div>'), F.col("x"), F.col("x"), F.lit('</div></div><a href="/txt/1/2">foot</a>'))
    return parse.catalog(pages.filter("book > 0").select(F.concat(F.lit("south-"), F.col("book").cast("string")).alias("book_id"), html.alias("html")), parse.NUMBERED, SOUTH).select("book_id", F.col("order_key").cast("long").alias("order_key"), "id", "title")


_CATALOGS_SQL = f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY o_totalprice, o_orderkey) AS pos FROM ({_entries_sql(200)}) WHERE book > 0),
b AS (SELECT book, arg_min(o_orderkey, pos) > arg_max(o_orderkey, pos) AS falls, book % 6 <> 0 AND (book % 3 <> 0 OR max(n) = 1) AS numbered FROM e GROUP BY book)
SELECT 'south-' || e.book AS book_id, row_number() OVER (PARTITION BY e.book ORDER BY CASE WHEN numbered THEN n WHEN falls THEN -pos ELSE pos END) - 1 AS order_key, CAST(o_orderkey AS VARCHAR) AS id, 't& ' || o_orderstatus AS title FROM e JOIN b USING (book)
"""


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a menu, a list and links between pages; every fourth book's pages have no list."""
    own = _entries(spark, sf_dir, 100).filter("book > 0")
    link = lambda target, title: F.concat(F.lit('<a href="/book/'), F.col("book").cast("string"), F.lit("/"), target, F.lit('.html">'), title, F.lit("</a>"))
    entry = F.concat(link(F.col("id"), F.concat(F.lit("第&nbsp;"), F.col("n").cast("string"), F.lit(" 章"))), F.when(F.col("n") % 5 == 0, link(F.concat(F.col("id"), F.lit("_1")), F.lit("more"))).otherwise(""))
    own = own.withColumn("id", (F.col("o_orderkey") + 1_000_000).cast("string")).withColumn("o_totalprice", F.lit(0))
    pages = own.groupBy("book", "page").agg(_joined(entry).alias("x"))
    menu, pager = link(F.lit("2000001"), F.lit("menu")), F.concat(link(F.lit("1999999"), F.lit("下一页")), link(F.lit("3"), F.lit("3")))
    html = F.when(F.col("book") % 4 == 0, F.concat(F.col("x"), pager)).otherwise(F.concat(menu, F.lit('<ul class="a section-list">'), F.col("x"), pager, F.lit("</ul>")))
    return parse.toc_items(pages.select(F.col("book").cast("string").alias("book_id"), "page", html.alias("html"))).withColumn("pos", F.col("pos").cast("long"))


def search_by_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _entries(spark, sf_dir, 50)
    toc = own.select(F.col("book").alias("book_id"), "page", F.col("n").alias("pos"), F.concat(F.lit("c"), (F.col("n") * 3).cast("string")).alias("title"), F.col("n").alias("number"), F.col("o_orderkey").alias("id"))
    ranges = statistics.number_ranges(toc).withColumn("total", F.lit(20))
    return search.toc_search_by_pages(toc, ranges, "12", around=1, limit=5).select("book_id", "page", F.col("pos").cast("long").alias("pos"), "id", "rank")


_SEARCH_SQL = f"""
WITH t AS (SELECT book AS book_id, page, n AS pos, 'c' || n * 3 AS title, n AS number, o_orderkey AS id FROM ({_entries_sql(50)})),
r AS (SELECT book_id, page, min(number) AS low, max(number) AS high FROM t GROUP BY ALL),
g AS (SELECT book_id, page, CASE WHEN 12 < low THEN low - 12 WHEN 12 > high THEN 12 - high ELSE 0 END AS gap, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN 12 < low THEN low - 12 WHEN 12 > high THEN 12 - high ELSE 0 END, page) AS k FROM r),
h AS (SELECT t.*, abs(t.page - CASE WHEN gap <= 200 THEN g.page ELSE 1 END) <= 1 AS near FROM t JOIN g ON g.book_id = t.book_id AND g.k = 1 WHERE contains(title, '12') OR number = 12 OR id = 12),
f AS (SELECT *, bool_or(near) OVER (PARTITION BY book_id) AS found FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS rank FROM f WHERE near OR NOT found)
SELECT book_id, page, pos, id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5
"""


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of chapters: every third with its lines encoded, the others in a container beside noise, all with ways to other chapters."""
    d = F.col("doc_id")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    body = F.concat(F.lit("<p>"), F.array_join(lines(escaped), "</p><p>"), F.lit("</p>"))
    title = F.concat(F.lit("第"), d.cast("string"), F.lit("章 x"))
    plain = F.concat(F.lit('<div class=a id="content"><div>加入书签</div>加入书架<br>'), title, F.lit("<br/>"), body, F.lit("</div><p>outside</p>"))
    encoded = F.concat(F.lit("<script>document.writeln(q.b('"), F.base64(F.encode(body, "UTF-8")), F.lit("'))</script><p>outside</p>"))
    link = lambda target, said: F.concat(F.lit("<a href='https://x.example.com/book/9/"), target, F.lit(".html?a#b'>"), F.lit(said), F.lit("</a>"))
    chapter = (d + 1_000_000).cast("string")
    head = F.concat(F.lit('<title>t</title><h2 class="chapter-title">'), title, F.lit("（第2页）</h2>"), F.when(d % 4 == 0, "<script>lastread.set('9','1','a','b','7')</script>").otherwise(""))
    ways = F.concat(link((d + 999_999).cast("string"), "上一章"), link(F.concat(chapter, F.lit("_3")), "下一页"), link(F.concat(chapter, F.lit("_1")), "2"), F.when(d % 5 > 0, link((d + 1_000_001).cast("string"), "下一章")).otherwise(""))
    html = F.concat(head, F.when(d % 3 == 0, encoded).otherwise(plain), ways)
    found = parse.chapter_pages(table(spark, sf_dir, "documents").select(F.lit("9").alias("book_id"), chapter.alias("chapter_id"), F.lit(1).alias("page_index"), html.alias("html")))
    digest = F.md5(F.array_join("paragraphs", "\n").cast("binary"))
    return found.select("chapter_id", "title", digest.alias("digest"), "prev_id", "next_id", F.array_join(F.transform("same_pages", lambda x: x.cast("string")), ",").alias("same_pages"), "declared_page")


def _parsed_sql() -> str:
    tidy = r"trim(regexp_replace(line, '[ \t　]+', ' ', 'g'), ' ')"
    return rf"""
WITH l AS (SELECT doc_id, unnest(range(len(l))) AS pos, replace(unnest(l), chr(160), ' ') AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, pos, regexp_replace({tidy}, '\A[{SPACE_SQL}]+|[{SPACE_SQL}]+\z', '', 'g') AS line FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS own FROM t WHERE line <> '' GROUP BY doc_id)
SELECT CAST(d.doc_id + 1000000 AS VARCHAR) AS chapter_id, '第' || d.doc_id || '章 x' AS title, md5(CASE WHEN d.doc_id % 3 = 0 THEN coalesce(own, 'outside') ELSE concat_ws(chr(10), '加入书签加入书架', own) END) AS digest, CAST(d.doc_id + 999999 AS VARCHAR) AS prev_id,
  CASE WHEN d.doc_id % 5 > 0 THEN CAST(d.doc_id + 1000001 AS VARCHAR) END AS next_id, '1,3' AS same_pages, CAST(CASE WHEN d.doc_id % 4 = 0 THEN 7 ELSE 1 END AS INTEGER) AS declared_page FROM documents d LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (other_source_chapters, cache_reads, beside_chapters, listed_catalogs, contents_pages, search_by_pages, parsed_pages)}


def oracle_sql() -> dict[str, str]:
    return {
        "other_source_chapters": f"""
            WITH e AS ({_entries_sql(50)}), b AS (SELECT book, max(page) AS total, count(*) FILTER (page <= 6) AS listed FROM e GROUP BY book),
            w AS (SELECT e.book, e.n, e.page, e.o_orderkey, b.total, greatest(7, ceil(e.n / greatest(1.0, b.listed / CAST(least(6, b.total) AS DOUBLE)))) AS guess FROM e JOIN b USING (book) WHERE e.n % 7 = 1)
            SELECT book AS book_id, '第' || n || '章' AS title, o_orderkey AS id, page FROM w WHERE page <= 6 OR (total > 6 AND page BETWEEN greatest(7, guess - 2) AND least(total, greatest(7, guess - 2) + 5))""",
        "cache_reads": f"""
            WITH c AS (SELECT url, {NOW} - page_id * 1000 + page_id % 5 * 60000 AS expires, length(html) AS size FROM pages WHERE page_id % 3 > 0 AND page_id % 5 > 0),
            l AS (SELECT url, expires, CAST(size AS INTEGER) AS size FROM c WHERE expires >= {NOW} QUALIFY row_number() OVER (PARTITION BY url ORDER BY expires DESC, size DESC) = 1)
            SELECT p.page_id, l.url IS NOT NULL AS hit, l.expires, l.size FROM pages p LEFT JOIN l USING (url)""",
        "beside_chapters": """
            WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), t AS (SELECT conv_id, turn, lag(turn) OVER w AS p, lead(turn) OVER w AS n, row_number() OVER w - 1 AS i FROM c WHERE turn % 4 <> 3 WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
            SELECT c.conv_id AS book_id, CAST(c.turn AS VARCHAR) AS chapter_id, coalesce(CAST(t.p AS VARCHAR), 'p' || c.turn) AS prev_id, coalesce(CAST(t.n AS VARCHAR), CASE WHEN c.turn % 2 = 0 THEN 'n' || c.turn END) AS next_id, t.i AS index FROM c LEFT JOIN t USING (conv_id, turn)""",
        "listed_catalogs": _CATALOGS_SQL,
        "contents_pages": f"SELECT CAST(book AS VARCHAR) AS book_id, page, row_number() OVER (PARTITION BY book, page ORDER BY o_orderkey) - 1 AS pos, CAST(o_orderkey + 1000000 AS VARCHAR) AS id, '第 ' || n || ' 章' AS title FROM ({_entries_sql(100)}) WHERE book > 0",
        "search_by_pages": _SEARCH_SQL,
        "parsed_pages": _parsed_sql(),
    }
