"""Tables of contents: classification of raw items, merging of pages, paging state."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import is_promotion, normal_title, rest_title

#: Ids further apart than this are of another upload.
UPLOAD_GAP = 1_000_000


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, middle: the value at the middle of each group, the upper one of two. Values are counted first, so a group is as long as it has
    distinct values, and no task collects its rows."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    own = Window.partitionBy(*keys)
    ranked = counts.withColumn("__to", F.sum("__n").over(own.orderBy(value))).withColumn("__half", F.floor(F.sum("__n").over(own) / 2))
    return ranked.filter(F.col("__to") > F.col("__half")).groupBy(*keys).agg(F.min(value).alias("middle"))


def with_titles(items: DataFrame) -> DataFrame:
    """Items (…, title) with display_title, number and extra; blank and promotional ones dropped."""
    own = items.withColumn("title", F.trim("title")).filter("title <> ''").filter(~is_promotion(F.col("title")))
    return own.withColumn("t", normal_title(F.col("title"))).select(*items.columns, "t.display_title", "t.number", "t.extra")


def without_outliers(items: DataFrame, keys: list[str], number: str = "number", from_page: int = 2) -> DataFrame:
    """Rows (keys with a page, number) without those whose positive number is under half or over twice the page's upper median."""
    positive = items.filter(F.col(number) > 0)
    middle = upper_medians(positive, keys, number)
    far = (F.col("page") >= from_page) & (F.col(number) > 0) & ((F.col(number) * 2 < F.col("middle")) | (F.col(number) > F.col("middle") * 2))
    return items.join(middle, keys, "left").filter(~F.coalesce(far, F.lit(False))).drop("middle")


def classify(items: DataFrame) -> DataFrame:
    """Entries of raw items (book_id, page, pos, id, title)."""
    own = with_titles(items)
    return without_outliers(own.filter("not extra"), ["book_id", "page"]).unionByName(own.filter("extra"))


class _Contents:
    """The main entries of one book that stay, taken in order of their ids.

    Numbers and rests (titles without the number) identify an entry; a placeholder has no rest. What decides is kept per number and per
    rest, and, for titled entries, the largest number up to each id.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.places: dict[int, dict[str, int]] = {}  # number -> rest -> place in rows
        self.first_id: dict[str, int] = {}
        self.titled: tuple[list[int], list[int]] = ([], [])  # ids, and the largest number among them so far

    def _far_maximum(self, entry_id: int) -> int:
        """The largest number of a titled entry of an earlier upload."""
        ids, largest = self.titled
        before = bisect.bisect_left(ids, entry_id - UPLOAD_GAP)
        return largest[before - 1] if before else 0

    def _is_upload_again(self, entry_id: int, number: int, rest: str) -> bool:
        if rest:
            return entry_id - self.first_id.setdefault(rest, entry_id) > UPLOAD_GAP
        return self._far_maximum(entry_id) >= number

    def take(self, entry_id: int, number: int, rest: str, row: tuple) -> None:
        known = self.places.setdefault(number, {})
        if rest in known or self._is_upload_again(entry_id, number, rest):
            return
        place = len(self.rows)
        if rest:
            ids, largest = self.titled
            ids.append(entry_id)
            largest.append(max(number, largest[-1] if largest else 0))
            early = known.get("")
            if early is not None and entry_id - self.rows[early][0] > UPLOAD_GAP:
                place = early  # a placeholder of an earlier upload gets its title where it stands
                del known[""]
        known[rest] = place
        self.rows[place : place + 1] = [(entry_id, row)]


def merge_main(entries: DataFrame) -> DataFrame:
    """book_id, order_key, id, title, display_title, number of main entries: first of each id in page order, by id, then without uploads of
    the same again.

    Which entries stay depends on those before, so it is a pass over the rows of a book; books are dealt to partitions and sorted there, and
    one pass goes over all books of a partition.
    """
    best = F.min_by(F.struct("title", "display_title", "number"), F.struct("page", "pos"))
    own = entries.filter("not extra").groupBy("book_id", "id").agg(best.alias("e"))
    own = own.select("book_id", "id", "e.title", "e.display_title", "e.number", rest_title(F.col("e.title"), F.col("e.display_title")).alias("rest"))
    own = own.repartition("book_id").sortWithinPartitions("book_id", F.col("id").cast("decimal(20,0)"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, kept = None, _Contents()

        def done() -> pa.RecordBatch:
            rows = [(book, k, *row) for k, (_, row) in enumerate(kept.rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for owner, entry_id, title, shown, number, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if owner != book:
                    if kept.rows:
                        yield done()
                    book, kept = owner, _Contents()
                kept.take(int(entry_id), number or 0, rest, (entry_id, title, shown, number))
        if kept.rows:
            yield done()

    return own.mapInArrow(run, "book_id string, order_key int, id string, title string, display_title string, number long")


_NAMES = ["book_id", "order_key", "id", "title", "display_title", "number"]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]


def merge_extras(entries: DataFrame) -> DataFrame:
    """book_id, order_key, …: the entry of largest id for each display title, by number (none last), then title."""
    best = entries.filter("extra").groupBy("book_id", "display_title").agg(F.max_by(F.struct("id", "title", "number"), F.col("id").cast("decimal(20,0)")).alias("e"))
    order = Window.partitionBy("book_id").orderBy(F.col("e.number").asc_nulls_last(), F.collate("e.title", "zh"), "e.title")
    return best.select("book_id", (F.row_number().over(order) - 1).alias("order_key"), "e.id", "e.title", "display_title", "e.number")


def merge(entries: DataFrame) -> DataFrame:
    """Main entries, then extras, with one running order_key."""
    both = merge_main(entries).withColumn("extra", F.lit(False)).unionByName(merge_extras(entries).withColumn("extra", F.lit(True)))
    order = Window.partitionBy("book_id").orderBy("extra", "order_key")
    return both.withColumn("order_key", F.row_number().over(order) - 1)


def page_state(pages: DataFrame) -> DataFrame:
    """book_id, state, next_page of pages (book_id, page, status, total_pages); status is loaded, failed or loading.

    A book is complete if all pages are loaded, loading while one is, exhausted if all others failed, else partial.
    """
    known = pages.groupBy("book_id").agg(F.max("total_pages").alias("total"), F.collect_set(F.when(F.col("status") == "loaded", F.col("page"))).alias("loaded"), F.collect_set(F.when(F.col("status") == "failed", F.col("page"))).alias("failed"), F.bool_or(F.col("status") == "loading").alias("loading"))
    left = F.array_except(F.array_except(F.sequence(F.lit(1), F.greatest("total", F.lit(1))), "loaded"), "failed")
    state = F.when(F.size("loaded") >= F.col("total"), "complete").when(F.col("loading"), "loading").when(F.size(left) == 0, "exhausted").otherwise("partial")
    return known.select("book_id", state.alias("state"), F.array_min(left).alias("next_page"))


def load_chunks(pages: DataFrame, most: int = 4) -> DataFrame:
    """book_id, first, last of runs of pages to load (book_id, page), ``most`` at a time."""
    order = Window.partitionBy("book_id").orderBy("page")
    runs = pages.distinct().withColumn("run", F.col("page") - F.row_number().over(order))
    chunks = runs.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("book_id", "run").orderBy("page")) - 1) / most))
    return chunks.groupBy("book_id", "run", "chunk").agg(F.min("page").alias("first"), F.max("page").alias("last")).select("book_id", "first", "last")


def shown(toc: DataFrame, which: str = "all") -> DataFrame:
    """All entries, those of the main text or the extras."""
    return toc if which == "all" else toc.filter(F.col("extra") == (which == "extra"))


def shown_counts(toc: DataFrame) -> DataFrame:
    """book_id, all, main, extra."""
    return toc.groupBy("book_id").agg(F.count("*").alias("all"), F.count_if(~F.col("extra")).alias("main"), F.count_if("extra").alias("extra"))


def range_result(pages: DataFrame) -> DataFrame:
    """book_id, total_pages (0 if no page says), pages and failed_pages of loaded ranges (book_id, page, outcome, total_pages)."""
    own = pages.groupBy("book_id").agg(
        F.coalesce(F.min_by("total_pages", F.when(F.col("total_pages").isNotNull(), F.col("page"))), F.lit(0)).alias("total_pages"),
        F.sort_array(F.collect_set(F.when(F.col("outcome") == "ok", F.col("page")))).alias("pages"),
        F.sort_array(F.collect_set(F.when(F.col("outcome") != "ok", F.col("page")))).alias("failed_pages"),
    )
    return own


def merge_by_source(entries: DataFrame, source: Column) -> DataFrame:
    """Contents of books of all sources: those of the main one are merged, others keep their order and the first entry of each id."""
    own = entries.withColumn("__main", source == "main")
    first = own.filter("not __main").groupBy("book_id", "id").agg(F.min(F.struct("page", "pos", "title", "display_title", "number", "extra")).alias("e"))
    order = Window.partitionBy("book_id").orderBy("e.page", "e.pos", "id")
    others = first.select("book_id", (F.row_number().over(order) - 1).alias("order_key"), "id", "e.title", "e.display_title", "e.number", "e.extra")
    return merge(own.filter("__main").drop("__main")).unionByName(others)


def merge_saved(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Contents after pages were saved: raw entries (book_id, page, ...) of the saved pages that did not come again, and the incoming ones,
    merged once."""
    kept = saved.join(incoming.select("book_id", "page").distinct(), ["book_id", "page"], "left_anti")
    return merge(kept.unionByName(incoming))


#: Pages of contents that are read while their number is unknown, and pages that a book has at most.
PROBE_PAGES, MOST_PAGES = 2, 1000


def last_page(total: Column, limit: Column) -> Column:
    """The last page that a load may read: all if their number is known (0: unknown), else the probe pages, within a limit (0: none)."""
    bound = F.when(total > 0, F.least(total, F.lit(MOST_PAGES))).otherwise(F.lit(PROBE_PAGES))
    return F.when(limit > 0, F.least(bound, limit)).otherwise(bound)


def total_after(total: Column, discovered: Column, page: Column) -> Column:
    """The number of pages after one was saved: the discovered one from 1 to 1000, else what the probe pages prove, else as before."""
    within = F.when(discovered.isNotNull(), F.greatest(F.lit(1), F.least(discovered, F.lit(MOST_PAGES))))
    return F.coalesce(within, F.when((total <= 0) & (page >= PROBE_PAGES), page).otherwise(total))
