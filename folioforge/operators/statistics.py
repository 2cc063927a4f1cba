"""Counts, sums and ordered views over stored books: plain aggregations, partial on each side of the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chapter_counts(chapters: DataFrame, by: str = "book_id") -> DataFrame:
    """by, complete, partial, bytes of chapters (by, complete, bytes); a null flag is not complete, missing sizes count 0."""
    done = F.coalesce(F.col("complete"), F.lit(False))
    return chapters.groupBy(by).agg(F.count_if(done).alias("complete"), F.count_if(~done).alias("partial"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def store_size(rows: DataFrame, size: str = "bytes") -> DataFrame:
    """One row: n and bytes (0 where a size is missing) of a store, also of an empty one."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def contents_counts(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """book_id, entries, loaded_pages of pages (book_id, page, status) and entries (book_id)."""
    loaded = pages.groupBy("book_id").agg(F.count_if(F.col("status") == "LOADED").alias("loaded_pages"))
    listed = entries.groupBy("book_id").agg(F.count("*").alias("entries"))
    both = loaded.join(listed, "book_id", "full")
    return both.select("book_id", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("loaded_pages", F.lit(0)).alias("loaded_pages"))


def task_counts(tasks: DataFrame, by: str = "book_id") -> DataFrame:
    """by, pending, failed."""
    return tasks.groupBy(by).agg(F.count_if(F.col("state") == "PENDING").alias("pending"), F.count_if(F.col("state") == "FAILED").alias("failed"))


def personal_counts(records: DataFrame) -> DataFrame:
    """book_id, bookmarks, history, has_progress of personal records (kind, book_id)."""
    kind = F.col("kind")
    return records.groupBy("book_id").agg(F.count_if(kind == "bookmark").alias("bookmarks"), F.count_if(kind == "history").alias("history"), F.bool_or(kind == "progress").alias("has_progress"))


def number_ranges(entries: DataFrame, least: int | None = 1) -> DataFrame:
    """book_id, page, low, high of the numbers from ``least`` (positive ones; None: all) on each page of contents."""
    wanted = entries if least is None else entries.filter(F.col("number") >= least)
    return wanted.groupBy("book_id", "page").agg(F.min("number").alias("low"), F.max("number").alias("high"))


def outcome_counts(results: DataFrame, by: list[str], outcome: str = "outcome") -> DataFrame:
    """by, done, skipped, failed and total of an import, export or download."""
    of = F.col(outcome)
    return results.groupBy(*by).agg(*[F.count_if(of == k).alias(k) for k in ("done", "skipped", "failed")], F.count("*").alias("total"))


def shelf(books: DataFrame, progress: DataFrame, history: DataFrame) -> DataFrame:
    """Books (book_id, title, added_at) with their progress (book_id, chapter_id, updated_at) and the chapter opened last (history: book_id,
    chapter_id, read_at), and opened_at, the time by which a shelf is ordered."""
    last = history.groupBy("book_id").agg(F.max_by("chapter_id", F.struct("read_at", "chapter_id")).alias("last_chapter"), F.max("read_at").alias("read_at"))
    own = progress.select("book_id", F.col("chapter_id").alias("progress_chapter"), "updated_at")
    return books.join(own, "book_id", "left").join(last, "book_id", "left").withColumn("opened_at", F.coalesce("updated_at", "added_at"))


def in_shelf_order(shelf_: DataFrame, limit: int | None = None) -> DataFrame:
    """What was opened last comes first, then by id; with a limit only the top of each task is sorted."""
    out = shelf_.orderBy(F.col("opened_at").desc_nulls_last(), "book_id")
    return out if limit is None else out.limit(limit)


def recent(rows: DataFrame, at: str, ties: list[str], limit: int, by: str | None = None) -> DataFrame:
    """The ``limit`` newest rows, of all or of each ``by``; ties by the largest of other columns."""
    order = [F.col(at).desc(), *[F.col(t).desc() for t in ties]]
    if by is None:
        return rows.orderBy(*order).limit(limit)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__n") <= limit).drop("__n")


def cached_flags(contents: DataFrame, chapters: DataFrame) -> DataFrame:
    """Contents (book_id, order_key, chapter_id) with cached and complete: whether a chapter is stored, and whole."""
    own = chapters.groupBy("book_id", "chapter_id").agg(F.bool_or(F.coalesce("complete", F.lit(False))).alias("complete"))
    both = contents.join(own, ["book_id", "chapter_id"], "left")
    return both.select("book_id", "order_key", "chapter_id", F.col("complete").isNotNull().alias("cached"), F.coalesce("complete", F.lit(False)).alias("complete"))


def missing_of(rows: DataFrame, keys: list[str], wanted: str, had: str) -> DataFrame:
    """Rows with missing: the members of one array column that another lacks, sorted; a null array is empty."""
    none = F.array().cast(rows.schema[wanted].dataType)
    return rows.select(*keys, F.sort_array(F.array_except(F.coalesce(wanted, none), F.coalesce(had, none))).alias("missing"))
