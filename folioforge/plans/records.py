"""Registered queries on responses, loads of contents, personal records, other sources and labels, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import SPACE_SQL
from ..operators import search, stores, toc
from ..sources import fetch_log, personal
from .tables import EVENTS_SQL, NOW, events, table


def fetch_outcomes(spark, d):
    """Pages as a fetch log with failed, foreign, wrongly typed and challenged responses."""
    k = F.col("page_id")
    status = F.when(k % 6 == 0, 404).when(k % 6 == 1, 500).when(k % 6 == 2, 403).otherwise(200)
    body = F.when(k % 11 == 0, "<title>Just a moment...</title>").otherwise(F.col("html")).cast("binary")
    final = F.when(k % 4 == 0, "https://other.example.com/").otherwise("https://pages.example.com/x")
    kind = F.when(k % 5 == 0, "image/png").otherwise("text/html; charset=utf-8")
    log = table(spark, d, "pages").select("page_id", "url", status.alias("status"), kind.alias("content_type"), body.alias("body"), final.alias("final_url"))
    found = fetch_log.classified(log, ["pages.example.com"])
    return found.select("page_id", "class", "retryable", "outcome", F.length("text").cast("long").alias("n_chars"))


def contents_states(spark, d):
    """Loads of contents by supplier: complete, loading, exhausted and partial ones."""
    kind, page = F.col("l_suppkey") % 4, F.col("l_orderkey")
    few = kind == 2
    pages = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("book_id"),
        F.when(few, page % 10 + 1).otherwise(page % 400 + 1).alias("page"),
        F.when(few, F.when(page % 10 < 5, "loaded").otherwise("failed")).when((kind == 0) & (F.col("l_returnflag") == "R"), "loading").when(F.col("l_returnflag") == "A", "failed").otherwise("loaded").alias("status"),
        F.when(few, 10).when(kind == 1, 50).otherwise(400).cast("long").alias("total_pages"),
    )
    return toc.page_state(pages)


def range_results(spark, d):
    turn = F.col("turn")
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), turn.alias("page"), F.when(F.col("role") == "assistant", "ok").otherwise("failed").alias("outcome"), F.when(turn % 3 == 1, turn + 5).alias("total_pages"))
    said = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return toc.range_result(pages).select("book_id", "total_pages", said("pages"), said("failed_pages"))


def _records(spark, d):
    """Personal records made of events; history for two kinds of events, progress for one, bookmarks for the others."""
    kind = F.when(F.col("event_type").isin("view", "click"), "history").when(F.col("event_type") == "purchase", "progress").otherwise("bookmark")
    return events(spark, d).select("user_id", "event_id", kind.alias("kind"), F.col("ms").alias("updated_at"))


_RECORDS_SQL = f"SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'history' WHEN event_type = 'purchase' THEN 'progress' ELSE 'bookmark' END AS kind, ms AS updated_at FROM ({EVENTS_SQL})"


def personal_merge(spark, d):
    """Records of even events are there, those of odd ones are merged in."""
    own = _records(spark, d).select("kind", (F.col("user_id") % 20).alias("book_id"), (F.col("event_id") % 97).cast("string").alias("id"), (F.col("event_id") % 100).cast("string").alias("chapter_id"), "updated_at", "event_id")
    return stores.merge_personal(own.filter("event_id % 2 = 0").drop("event_id"), own.filter("event_id % 2 = 1").drop("event_id"))


def personal_roundtrip(spark, d):
    """Records to one document for each user and back."""
    own = _records(spark, d).select("user_id", "kind", F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("book_id"), F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 1000).cast("string").alias("chapter_id"), "updated_at")
    back, _ = personal.import_json(personal.export_json(own))
    return back.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.sum("updated_at").alias("total"))


def library_import(spark, d):
    """Books of a backup are added where they are not there yet."""
    own = table(spark, d, "customer").select("c_custkey", "c_name")
    return stores.add_missing(own.filter("c_custkey % 3 > 0"), own.filter("c_custkey % 2 = 0").withColumn("c_name", F.lit("imported")), ["c_custkey"])


def cache_health(spark, d):
    """Chapters of all versions and origins: whether they are current, and which a purge takes."""
    k = F.col("doc_id")
    own = table(spark, d, "documents").select("doc_id", F.when(k % 4 == 0, "local").otherwise("remote").alias("source"), F.when(k % 6 < 5, k % 6).cast("int").alias("v"), (k % 3 > 0).alias("complete"))
    own = own.withColumn("current", stores.is_current(F.col("v"), F.col("source") == "local", F.col("complete")))
    purged = stores.stale(own).select("doc_id", F.lit(True).alias("gone"))
    return own.join(purged, "doc_id", "left").select("doc_id", "current", F.coalesce("gone", F.lit(False)).alias("purged"))


def remote_cleared(spark, d):
    """Fetched chapters of the largest sources go, imported ones stay."""
    own = table(spark, d, "documents").select("doc_id", F.col("source").alias("book_id"), F.when(F.col("doc_id") % 4 == 0, "local").when(F.col("doc_id") % 4 == 1, "remote").alias("source"))
    books = own.groupBy("book_id").count().orderBy(F.col("count").desc(), "book_id").limit(3)
    return stores.without_remote(own, books).groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "local").alias("n_local"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def other_sources(spark, d):
    """Hits of another source for each book: the same title in any case and spacing first."""
    said = F.element_at(F.array(*[F.lit(f" {s[:3].lower()}　{s[3:]}") for s in _SEGMENTS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("hit_id"), said.alias("title"))
    return search.alternatives(table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_mktsegment").alias("title")), hits)


def text_labels(spark, d):
    own = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text.excerpt(own, 24).alias("excerpt"),
        text.format_bytes(F.octet_length(own).cast("long")).alias("size"),
        text.utf8_size(F.array(own, own)).alias("bytes"),
        text.search_query(F.left(own, (F.col("doc_id") % 50).cast("int"))).alias("query"),
        text.cover_text(own).alias("cover"),
        text.backoff_ms(F.col("doc_id") % 6).alias("wait"),
    )


def shown_times(spark, d):
    return events(spark, d).select("event_id", text.format_time(F.col("ms"), F.lit(NOW)).alias("shown"))


def retry_times(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    header = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", text.retry_after_seconds(header, F.lit("1995-01-01 00:00:00").cast("timestamp")).alias("seconds"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (fetch_outcomes, contents_states, range_results, personal_merge, personal_roundtrip, library_import, cache_health, remote_cleared, other_sources, text_labels, shown_times, retry_times)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    joined = "lower(regexp_replace({}, '\\s|　', '', 'g'))"
    collapsed = lambda c: f"regexp_replace(regexp_replace({c}, '[{SPACE_SQL}]+', ' ', 'g'), '\\A | \\z', '', 'g')"
    return {
        "fetch_outcomes": """WITH l AS (SELECT page_id, html, page_id % 11 = 0 AS c, CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 403 ELSE 200 END AS s FROM pages),
            k AS (SELECT *, CASE WHEN s = 403 AND c THEN 'blocked' WHEN s <> 200 THEN 'http' WHEN page_id % 4 = 0 THEN 'redirected' WHEN page_id % 5 = 0 THEN 'invalid' WHEN c THEN 'blocked' ELSE 'ok' END AS class FROM l)
            SELECT page_id, class, class = 'http' AND s >= 500 AS retryable, CASE WHEN class = 'ok' THEN 'ok' WHEN class = 'http' AND s = 404 THEN 'not_found' ELSE 'failed' END AS outcome, CASE WHEN c THEN 31 ELSE length(html) END AS n_chars FROM k""",
        "contents_states": """WITH p AS (SELECT DISTINCT l_suppkey AS b, CASE WHEN l_suppkey % 4 = 2 THEN l_orderkey % 10 + 1 ELSE l_orderkey % 400 + 1 END AS page,
              CASE WHEN l_suppkey % 4 = 2 THEN CASE WHEN l_orderkey % 10 < 5 THEN 'loaded' ELSE 'failed' END WHEN l_suppkey % 4 = 0 AND l_returnflag = 'R' THEN 'loading' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'loaded' END AS s FROM lineitem),
            t AS (SELECT b, CASE b % 4 WHEN 2 THEN 10 WHEN 1 THEN 50 ELSE 400 END AS total, count(*) FILTER (s = 'loaded') AS loaded, bool_or(s = 'loading') AS loading FROM p GROUP BY b),
            a AS (SELECT b, unnest(range(1, total + 1)) AS page FROM t), o AS (SELECT a.b, min(a.page) AS page FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.b = a.b AND p.page = a.page AND p.s <> 'loading') GROUP BY a.b)
            SELECT t.b AS book_id, CASE WHEN loaded >= total THEN 'complete' WHEN loading THEN 'loading' WHEN o.page IS NULL THEN 'exhausted' ELSE 'partial' END AS state, o.page AS next_page FROM t LEFT JOIN o ON o.b = t.b""",
        "range_results": """SELECT conv_id AS book_id, coalesce(min(turn) FILTER (turn % 3 = 1) + 5, 0) AS total_pages, coalesce(string_agg(DISTINCT CAST(turn AS VARCHAR), ',' ORDER BY CAST(turn AS VARCHAR)) FILTER (role = 'assistant'), '') AS pages,
            coalesce(string_agg(DISTINCT CAST(turn AS VARCHAR), ',' ORDER BY CAST(turn AS VARCHAR)) FILTER (role <> 'assistant'), '') AS failed_pages FROM conversations GROUP BY conv_id""",
        "personal_merge": f"""WITH b AS (SELECT kind, user_id % 20 AS book_id, CAST(event_id % 97 AS VARCHAR) AS id, CAST(event_id % 100 AS VARCHAR) AS chapter_id, updated_at, event_id % 2 AS new FROM ({_RECORDS_SQL})),
            k AS (SELECT *, row_number() OVER (PARTITION BY kind, book_id, CASE kind WHEN 'bookmark' THEN id WHEN 'history' THEN chapter_id ELSE '' END ORDER BY CASE WHEN kind = 'bookmark' THEN -new ELSE updated_at END DESC, new, updated_at DESC, id, chapter_id) AS n FROM b),
            r AS (SELECT *, row_number() OVER (PARTITION BY kind, book_id ORDER BY updated_at DESC, id, chapter_id) AS r FROM k WHERE n = 1)
            SELECT kind, book_id, id, chapter_id, updated_at FROM r WHERE kind <> 'history' OR r <= 30""",
        "personal_roundtrip": f"""WITH b AS (SELECT user_id, kind, event_id % 3 AS book, updated_at FROM ({_RECORDS_SQL})),
            p AS (SELECT user_id, kind, updated_at FROM b WHERE kind <> 'progress' UNION ALL SELECT user_id, kind, max(updated_at) FROM b WHERE kind = 'progress' GROUP BY user_id, kind, book)
            SELECT user_id, kind, count(*) AS n, CAST(sum(updated_at) AS BIGINT) AS total FROM p GROUP BY user_id, kind""",
        "library_import": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE 'imported' END AS c_name FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0",
        "cache_health": "SELECT doc_id, doc_id % 4 = 0 OR (doc_id % 6 = 4 AND doc_id % 3 > 0) AS current, doc_id % 4 > 0 AND doc_id % 6 <> 4 AS purged FROM documents",
        "remote_cleared": """WITH t AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 3)
            SELECT source AS book_id, count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS n_local FROM documents WHERE doc_id % 4 = 0 OR source NOT IN (SELECT source FROM t) GROUP BY source""",
        "other_sources": f"""WITH h AS (SELECT o_custkey AS book_id, o_orderkey AS hit_id, {joined.format("(['aut　OMOBILE', 'bui LDING', 'fur　NITURE', ' HOUSEHOLD', 'machinery'])[CAST(o_orderkey % 5 + 1 AS INT)]")} AS k FROM orders),
            r AS (SELECT book_id, hit_id, k = {joined.format("c_mktsegment")} AS exact, row_number() OVER (PARTITION BY book_id ORDER BY k <> {joined.format("c_mktsegment")}, hit_id) AS n FROM h JOIN customer ON c_custkey = book_id)
            SELECT book_id, hit_id, exact FROM r WHERE n = 1""",
        "text_labels": f"""WITH t AS (SELECT doc_id, text, octet_length(encode(text)) AS b, {collapsed("text")} AS c, left(text, CAST(doc_id % 50 AS INT)) AS q FROM documents)
            SELECT doc_id, CASE WHEN length(c) > 24 THEN left(c, 24) || '…' ELSE c END AS excerpt, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(CAST(b AS DOUBLE) / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(CAST(b AS DOUBLE) / 1048576 * 10 + 0.5) / 10) END AS size,
            CAST(2 * b AS BIGINT) AS bytes, CASE WHEN NOT regexp_matches(q, '[\\x00-\\x1f\\x7f]') AND length({collapsed("q")}) BETWEEN 1 AND 30 THEN {collapsed("q")} END AS query,
            left(regexp_replace(text, '[{SPACE_SQL}]+', '', 'g'), 4) AS cover, CAST(least(4000, 400 * pow(2, doc_id % 6)) AS BIGINT) AS wait FROM t""",
        "shown_times": f"SELECT event_id, CASE WHEN epoch_ms(ms)::DATE = epoch_ms({NOW})::DATE THEN strftime(epoch_ms(ms), '%H:%M') WHEN year(epoch_ms(ms)) = year(epoch_ms({NOW})) THEN strftime(epoch_ms(ms), '%m-%d %H:%M') ELSE strftime(epoch_ms(ms), '%Y-%m-%d') END AS shown FROM ({EVENTS_SQL})",
        "retry_times": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN greatest(CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) - epoch(TIMESTAMP '1995-01-01') AS BIGINT), 0) END AS seconds FROM orders",
    }
