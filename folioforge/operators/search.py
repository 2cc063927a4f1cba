"""Look-ups: substring search, places of matches, nearest rows, ranges of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import title_key

LIMIT = 60


def toc_search(toc: DataFrame, query: str, limit: int = LIMIT, title: str = "title", order: tuple[str, ...] = ("pos",), number: str | None = None, id_col: str | None = None) -> DataFrame:
    """Entries whose title holds the query in any case or, for a numeric one, whose number or id it is; the first ``limit`` in order."""
    hit = _is_hit(query.strip(), title, number, id_col)
    return toc.filter(hit).orderBy(*order).limit(limit)


def match_counts(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-overlapping occurrences in any case, per row that has any."""
    n = F.size(F.split(F.lower(text_col), re.escape(query.lower()), -1)) - 1
    return docs.select(F.col(id_col), n.cast("long").alias("n_matches")).filter("n_matches > 0")


def match_places(paragraphs: DataFrame, query: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, start, end of each occurrence in any case, in UTF-16 units of the original text."""
    pattern = re.compile(re.escape(query), re.IGNORECASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = lambda s: len(s.encode("utf-16-le", "surrogatepass")) // 2
        for batch in batches:
            rows, starts, ends = [], [], []
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                at = units_at = 0
                for m in pattern.finditer(text or ""):
                    units_at += units(text[at : m.start()])
                    at = m.start()
                    rows.append(k)
                    starts.append(units_at)
                    ends.append(units_at + units(m[0]))
            picked = [c.take(pa.array(rows, pa.int32())) for c in batch.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [*keys, "start", "end"])

    schema = ", ".join(f"`{k}` {paragraphs.schema[k].dataType.simpleString()}" for k in keys)
    return paragraphs.select(*keys, text_col).mapInArrow(run, f"{schema}, start int, end int")


def match_page(places: DataFrame, owner: list[str], order: list[str], start: int, size: int = 500) -> DataFrame:
    """Matches ``start`` to ``start + size`` of each owner, with its total."""
    own = Window.partitionBy(*owner)
    ranked = places.withColumn("total", F.count("*").over(own)).withColumn("index", F.row_number().over(own.orderBy(*order)) - 1)
    return ranked.filter(F.col("index").between(start, start + size - 1))


def nearest_in_band(probes: DataFrame, points: DataFrame, keys: list[str], at: str, band: int, id_col: str) -> DataFrame:
    """For each probe (keys, at) the point of the same keys nearest to it within ``band``, ties to the smallest id.

    Points are dealt to cells of a band's width and probes to the three cells around them, so the join is by equality.
    """
    cell = lambda c: F.floor(c / max(band, 1))
    left = probes.select(*keys, F.col(at).alias("at")).distinct().withColumn("cell", F.explode(F.sequence(cell(F.col("at")) - 1, cell(F.col("at")) + 1)))
    right = points.select(*keys, F.col(at).alias("point"), F.col(id_col).alias("id"), cell(F.col(at)).alias("cell"))
    gap = F.abs(F.col("point") - F.col("at"))
    near = left.join(right, [*keys, "cell"]).filter(gap <= band)
    return near.groupBy(*keys, "at").agg(F.min(F.struct(gap.alias("gap"), "id", "point")).alias("n")).select(*keys, F.col("at").alias(at), "n.id", "n.point", "n.gap")


def page_for_number(ranges: DataFrame, number: int, per_page: int = 100, near: int = 200) -> DataFrame:
    """book_id, page of ranges (book_id, page, low, high, total): the page that holds the number, else the nearest within ``near``, else by division."""
    gap = F.when(F.lit(number) < F.col("low"), F.col("low") - number).when(F.lit(number) > F.col("high"), F.lit(number) - F.col("high")).otherwise(0)
    best = ranges.groupBy("book_id").agg(F.min(F.struct(gap.alias("gap"), "page")).alias("b"), F.max("total").alias("total"))
    guess = F.greatest(F.lit(1), F.least(F.ceil(F.lit(number) / per_page).cast("int"), F.col("total")))
    return best.select("book_id", F.when(F.col("b.gap") <= near, F.col("b.page")).otherwise(guess).alias("page"))


def nearest_number(toc: DataFrame, number: int, by: str = "book_id") -> DataFrame:
    """The entry whose number is nearest, the first of equals."""
    return toc.filter("number is not null").groupBy(by).agg(F.min_by(F.struct("pos", "number"), F.struct(F.abs(F.col("number") - number), F.col("pos"))).alias("e")).select(by, "e.*")


def neighbours(rows: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Rows with prev_id, next_id and index."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"prev_id": F.lag(id_col).over(w), "next_id": F.lead(id_col).over(w), "index": F.row_number().over(w) - 1})


def due_tasks(tasks: DataFrame, now: int, limit: int) -> DataFrame:
    """Pending tasks, and retries that are due, by priority and time."""
    due = (F.col("state") == "PENDING") | ((F.col("state") == "RETRY_AT") & (F.col("next_attempt_at") <= now))
    return tasks.filter(due).orderBy(F.col("priority").desc(), "next_attempt_at", "task_id").limit(limit)


def reset_orphans(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("state", F.when(F.col("state") == "RUNNING", "PENDING").otherwise(F.col("state")))


def alternatives(books: DataFrame, hits: DataFrame) -> DataFrame:
    """book_id, hit_id, exact of the search hits (book_id, rank, hit_id, title) of books (book_id, title): the first of the same title key,
    else the first. Books without hits give no row."""
    both = hits.withColumnRenamed("title", "hit_title").join(books.select("book_id", "title"), "book_id")
    exact = title_key(F.col("title")) == title_key(F.col("hit_title"))
    return both.groupBy("book_id").agg(F.min_by(F.struct("hit_id", exact.alias("exact")), F.struct(~exact, F.col("rank"))).alias("h")).select("book_id", "h.*")


def same_chapter(chapter: DataFrame, other: DataFrame) -> DataFrame:
    """book_id, chapter_id, other_id of chapters (book_id, chapter_id, title) with the same title key in another source, first by pos."""
    left = chapter.select("book_id", "chapter_id", title_key(F.col("title")).alias("key"))
    right = other.select("book_id", F.col("chapter_id").alias("other_id"), "pos", title_key(F.col("title")).alias("key"))
    return left.join(right, ["book_id", "key"]).groupBy("book_id", "chapter_id").agg(F.min_by("other_id", "pos").alias("other_id"))


#: Pages of another source's contents that are read first, and the most that a second look reads.
FIRST_PAGES, SECOND_PAGES = 6, 6


def other_page_window(title: Column, listed: Column, total: Column) -> Column:
    """struct(low, high): the pages of another source's contents on which a chapter may be that the first pages, with ``listed`` entries, don't have. The number in its title by the
    entries of a page gives the page, two before and three behind it count too; null if there are no more pages, or the title has no number, or that lies beyond the last."""
    number = F.nullif(F.regexp_extract(title, "第([0-9]{1,9})[章节回话]", 1), F.lit("")).cast("double")
    per_page = F.greatest(F.lit(1.0), listed / F.least(F.lit(FIRST_PAGES), total))
    guess = F.greatest(F.lit(FIRST_PAGES + 1), F.ceil(number / per_page).cast("int"))
    low = F.greatest(F.lit(FIRST_PAGES + 1), guess - 2)
    return F.when(number.isNotNull() & (total > FIRST_PAGES) & (low <= total), F.struct(low.alias("low"), F.least(total, low + SECOND_PAGES - 1).alias("high")))


def in_other_source(wanted: DataFrame, entries: DataFrame, totals: DataFrame) -> DataFrame:
    """(book_id, title, id, page) of the chapters ``wanted`` (book_id, title) in the contents of another source (book_id, page, pos, id, title, display_title) that has total_pages
    (``totals``): the first entry of the same title key on the first pages, else on those of ``other_page_window``. Chapters without one give no row."""
    keys = F.explode(F.array_distinct(F.array(title_key(F.col("title")), title_key(F.col("display_title"))))).alias("key")
    keyed = entries.select("book_id", "page", "pos", "id", keys).filter("key is not null")
    listed = entries.filter(F.col("page") <= FIRST_PAGES).groupBy("book_id").agg(F.count("*").alias("listed"))
    own = wanted.select("book_id", "title", title_key(F.col("title")).alias("key")).distinct().join(totals, "book_id").join(listed, "book_id", "left")
    own = own.withColumn("window", other_page_window(F.col("title"), F.coalesce("listed", F.lit(0)), F.col("total_pages")))
    near = (F.col("page") <= FIRST_PAGES) | F.col("page").between(F.col("window.low"), F.col("window.high"))
    found = own.join(keyed, ["book_id", "key"]).filter(F.coalesce(near, F.lit(False)))
    return found.groupBy("book_id", "title").agg(F.min_by(F.struct("id", "page"), F.struct("page", "pos", "id")).alias("e")).select("book_id", "title", "e.*")


def beside(chapters: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters (book_id, chapter_id, prev_id, next_id) with the neighbours that the contents (book_id, order_key, chapter_id) give them, or where these have none, for want of
    the chapter or at an end, those stored with it; index is the place in the contents, null outside."""
    order = Window.partitionBy("book_id").orderBy("order_key")
    placed = toc.select("book_id", "chapter_id", F.lag("chapter_id").over(order).alias("__prev"), F.lead("chapter_id").over(order).alias("__next"), (F.row_number().over(order) - 1).alias("index"))
    own = chapters.join(placed, ["book_id", "chapter_id"], "left")
    return own.withColumns({"prev_id": F.coalesce("__prev", "prev_id"), "next_id": F.coalesce("__next", "next_id")}).drop("__prev", "__next")


def toc_search_by_pages(toc: DataFrame, ranges: DataFrame, query: str, around: int = 3, limit: int = LIMIT) -> DataFrame:
    """``toc_search`` of contents (book_id, page, pos, title, number, id), book by book, that looks first at the pages around the one that can hold the number asked for; at all pages of a
    book that has nothing there, or if the query is no number. At most ``limit`` entries of each book, with rank."""
    own = query.strip()
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))
    hits = toc.filter(_is_hit(own, "title", "number", "id"))
    if re.fullmatch(r"\d+", own):
        near = hits.join(page_for_number(ranges, int(own)).withColumnRenamed("page", "__page"), "book_id", "left").withColumn("__near", F.coalesce(F.abs(F.col("page") - F.col("__page")) <= around, F.lit(False)))
        # Hits are few; whether a book has a near one is told beside them.
        found = F.max("__near").over(Window.partitionBy("book_id"))
        hits = near.withColumn("__found", found).filter(F.col("__near") | ~F.col("__found")).drop("__page", "__near", "__found")
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _is_hit(own: str, title: str, number: str | None, id_col: str | None) -> Column:
    hit = F.contains(F.lower(title), F.lit(own.lower()))
    if re.fullmatch(r"\d+", own):
        if number:
            hit = hit | (F.col(number) == int(own))
        if id_col:
            hit = hit | (F.col(id_col).cast("string") == own)
    return hit
