"""Personal data as one JSON document per user, and back, checked field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repair import depth

MOST_BYTES, MOST_BOOKS, MOST_RECORDS, MOST_DEPTH = 4 << 20, 1000, 10_000, 32
RECORD = "struct<id:string,chapter_id:string,updated_at:bigint>"
DOCUMENT = f"version int, books map<string, struct<progress:{RECORD}, bookmarks:array<{RECORD}>, history:array<{RECORD}>>>"
KEY = r"\A[A-Za-z0-9_-]{1,64}\z"


def export_json(records: DataFrame, version: int = 1) -> DataFrame:
    """user_id, document of records (user_id, kind, book_id, id, chapter_id, updated_at)."""
    record = F.struct("id", "chapter_id", "updated_at")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, record)))
    books = records.groupBy("user_id", "book_id").agg(F.max_by(F.when(F.col("kind") == "progress", record), F.when(F.col("kind") == "progress", F.col("updated_at"))).alias("progress"), of("bookmark").alias("bookmarks"), of("history").alias("history"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("book_id", F.struct("progress", "bookmarks", "history")))))
    return books.groupBy("user_id").agg(F.to_json(F.struct(F.lit(version).alias("version"), entries.alias("books"))).alias("document"))


def import_json(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of documents (user_id, document): valid ones as records; the others with a reason.

    Records with a bad key, no chapter or a negative time are dropped from a valid document.
    """
    parsed = documents.withColumn("d", F.from_json("document", DOCUMENT))
    sizes = F.aggregate(F.map_values("d.books"), F.lit(0), lambda n, b: n + F.coalesce(F.size(b["bookmarks"]), F.lit(0)) + F.coalesce(F.size(b["history"]), F.lit(0)))
    reason = (
        F.when(F.octet_length("document") > MOST_BYTES, "too large")
        .when(depth(F.col("document")) > MOST_DEPTH, "nested too deeply")
        .when(F.col("d").isNull() | F.col("d.books").isNull(), "not a personal document")
        .when(F.size("d.books") > MOST_BOOKS, "too many books")
        .when(sizes > MOST_RECORDS, "too many records")
    )
    parsed = parsed.withColumn("reason", reason)
    books = parsed.filter("reason is null").select("user_id", F.explode("d.books").alias("book_id", "b"))
    kinds = [("progress", F.array("b.progress")), ("bookmark", F.col("b.bookmarks")), ("history", F.col("b.history"))]
    each = books.select("user_id", "book_id", F.explode(F.concat(*[F.transform(F.coalesce(a, F.array().cast(f"array<{RECORD}>")), _tagged(k)) for k, a in kinds])).alias("r"))
    rows = each.select("user_id", "r.kind", "book_id", "r.id", "r.chapter_id", "r.updated_at")
    valid = F.col("book_id").rlike(KEY) & F.col("chapter_id").rlike(r"\A[0-9]{1,12}\z") & (F.col("updated_at") >= 0) & (F.col("id").isNull() | F.col("id").rlike(KEY))
    return rows.filter(valid), parsed.filter("reason is not null").select("user_id", "reason")


def _tagged(kind: str):
    return lambda r: F.struct(F.lit(kind).alias("kind"), r["id"].alias("id"), r["chapter_id"].alias("chapter_id"), r["updated_at"].alias("updated_at"))
