"""Keyed state as tables: upserts, merges, guards, deletes, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A stored chapter of this version is current.
VERSION = 4


def last_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def newest(rows: DataFrame, keys: list[str], at: str, ties: list[str] | None = None) -> DataFrame:
    """One row per key, that with the largest ``at`` (and then the largest ties); no sort, partial aggregation on each side."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(at, *(ties or []), *[c for c in rest if c != at])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def oldest(rows: DataFrame, keys: list[str], at: str, ties: list[str] | None = None) -> DataFrame:
    """One row per key, that with the smallest ``at`` (and then the smallest ties); null times count last."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(at).isNull(), at, *(ties or []), *[c for c in rest if c != at])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def upsert_nonblank(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New non-blank fields replace old ones; blanks never do; keys on either side alone stay. Of several new rows of a key the largest non-blank
    value of each field counts."""
    fields = [c for c in old.columns if c not in keys]
    # Of new rows with one key the largest value of each field counts, so that no row of the old side is multiplied.
    right = new.groupBy(*keys).agg(*[F.max(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))).alias(f"__{c}") for c in fields])
    kept = [F.coalesce(F.when(F.trim(F.col(f"__{c}").cast("string")) != "", F.col(f"__{c}")), F.col(c)).alias(c) for c in fields]
    return old.join(right, keys, "full").select(*keys, *kept)


def never_shrink(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters with char_count and paragraph_count: a new one is taken unless it is empty or the old one has more of either. Of
    several new ones of a key the longest counts."""
    fields = [c for c in old.columns if c not in keys]
    longest = F.max_by(F.struct(*fields), F.struct("char_count", "paragraph_count", *[F.col(c).cast("string") for c in fields if c not in ("char_count", "paragraph_count")]))
    right = new.groupBy(*keys).agg(longest.alias("n")).select(*keys, *[F.col(f"n.{c}").alias(f"__{c}") for c in fields], F.lit(True).alias("__new"))
    left = old.withColumn("__old", F.lit(True))
    larger = (F.col("char_count") > F.col("__char_count")) | (F.col("paragraph_count") > F.col("__paragraph_count"))
    take = F.col("__new").isNotNull() & (F.col("__char_count") > 0) & (F.col("__old").isNull() | ~larger)
    both = left.join(right, keys, "full").withColumn("__take", F.coalesce(take, F.lit(False))).filter("__take or __old")
    return both.select(*keys, *[F.when(F.col("__take"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields])


def add_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` are added only for keys that ``old`` lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def top_history(events: DataFrame, owner: str, item: str, at: str, most: int = 30) -> DataFrame:
    """The ``most`` items opened last for each owner, each with its last time and rank. Aggregated before it is ranked, so only one
    row per owner and item is shuffled for the ranking, and of these only the top of each task."""
    last = events.groupBy(owner, item).agg(F.max(at).alias(at))
    order = Window.partitionBy(owner).orderBy(F.col(at).desc(), F.col(item))
    return last.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def merge_personal(old: DataFrame, new: DataFrame, most: int = 30) -> DataFrame:
    """Personal records (kind, book_id, id, chapter_id, updated_at): bookmarks by id, first wins; history newest per chapter, the
    ``most`` newest; progress newest, of equal ones the old."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    key = F.when(F.col("kind") == "bookmark", F.col("id")).when(F.col("kind") == "history", F.col("chapter_id")).otherwise(F.lit(""))
    first = F.when(F.col("kind") == "bookmark", -F.col("__new")).otherwise(F.col("updated_at"))
    order = Window.partitionBy("kind", "book_id", "__key").orderBy(F.col("__first").desc(), "__new", F.col("updated_at").desc(), "id", "chapter_id")
    one = both.withColumn("__key", key).withColumn("__first", first).withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    rank = Window.partitionBy("kind", "book_id").orderBy(F.col("updated_at").desc(), "id", "chapter_id")
    kept = one.withColumn("__rank", F.row_number().over(rank)).filter((F.col("kind") != "history") | (F.col("__rank") <= most))
    return kept.select(*old.columns)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_book(tables: dict[str, DataFrame], books: DataFrame, personal: tuple[str, ...] = ("bookmarks", "reading_history", "reading_progress")) -> dict[str, DataFrame]:
    """The tables without the rows of some books (book_id); personal ones are kept."""
    return {name: t if name in personal else delete_keys(t, books, ["book_id"]) for name, t in tables.items()}


def is_current(row_version: Column, is_local: Column, complete: Column) -> Column:
    return is_local | (row_version.eqNullSafe(F.lit(VERSION)) & F.coalesce(complete, F.lit(False)))


def stale(chapters: DataFrame, version: int = VERSION) -> DataFrame:
    """Fetched chapters of another or no version."""
    return chapters.filter((F.col("source") != "local") & ~F.col("v").eqNullSafe(F.lit(version)))


def live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires") >= now)


def cache_read(requests: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """Requests with what the cache (key, expires and further columns) holds for their key and hit. An entry whose time has passed is none; of several of a key the one that lasts longest
    counts, of equal ones that with the largest values. Misses have nulls."""
    own = newest(live(cache, now), [key], "expires").withColumn("hit", F.lit(True))
    return requests.join(own, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def with_max_age(responses: DataFrame, stored_at: str, max_age: Column) -> DataFrame:
    """Responses with expires, in milliseconds: ``max_age`` seconds after they were stored; without a positive one they are not kept."""
    return responses.withColumn("expires", F.col(stored_at) + max_age * 1000).filter(max_age > 0)


def lru_victims(touches: DataFrame, key: str, at: str, capacity: int) -> DataFrame:
    """Keys beyond the ``capacity`` touched last. Ranks are taken within ranges of last touch, so no task gets all keys."""
    last = touches.groupBy(key).agg(F.max(at).alias("last_touch"))
    keep = last.orderBy(F.col("last_touch").desc(), F.col(key)).limit(capacity)
    return last.join(keep.select(key), key, "left_anti")


def renumber(rows: DataFrame, keys: list[str], order: list[str], page_size: int = 100) -> DataFrame:
    """Rows with pos from 0 and page from 1 within their keys."""
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("pos", pos).withColumn("page", (F.floor(F.col("pos") / page_size) + 1).cast("int"))


def read(rows: DataFrame, columns: list[str] | None = None, **keys) -> DataFrame:
    """Rows whose columns have the given values, or one of a list of values; only the named columns, so ids alone read ids alone."""
    out = rows
    for name, value in keys.items():
        out = out.filter(F.col(name).isin(value) if isinstance(value, list) else F.col(name).eqNullSafe(F.lit(value)))
    return out.select(*columns) if columns else out


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a store as an ordered read gives them: by keys, and within them by ``order`` (a name with "-" before it falls), nulls last."""
    by = lambda c: F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c)
    return rows.orderBy(*keys, *map(by, order))


def write(rows: DataFrame, path: str, by: str = "book_id") -> None:
    """A store as one Parquet folder per value of ``by``; folders of values that ``rows`` has are replaced, others stay. A value's rows are
    dealt to several tasks when they are many."""
    rows.repartition(by, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def deleted(rows: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number of existing keys that went)."""
    own = gone.select(*keys).distinct()
    return rows.join(own, keys, "left_anti"), rows.join(own, keys, "left_semi").select(*keys).distinct().agg(F.count("*").alias("deleted"))


def without_remote(chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Chapters without the fetched ones of some books (book_id); imported ones stay."""
    return chapters.filter("source = 'local'").unionByName(chapters.filter("source is null or source <> 'local'").join(books.select("book_id"), "book_id", "left_anti"))


def cache_path(key: Column, folder: str) -> Column:
    """Where a response is kept: the folder and the SHA-1 of its key, spread over subfolders by the first two digits."""
    digest = F.sha1(key.cast("binary"))
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.left(digest, F.lit(2)), F.lit("/"), digest, F.lit(".json"))


def with_status(rows: DataFrame, changes: DataFrame, keys: list[str], status: str = "status", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the status that ``changes`` (keys, at, status) give them last, of equal times that with the largest ties and then the largest status; others keep theirs."""
    last = changes.groupBy(*keys).agg(F.max_by(status, F.struct("at", *ties, status)).alias("__status"))
    return rows.join(last, keys, "left").withColumn(status, F.coalesce("__status", status)).drop("__status")


def pending(pages: DataFrame, status: str = "status", done: str = "LOADED") -> DataFrame:
    """Pages that are not loaded; an unknown status is not."""
    return pages.filter(~F.col(status).eqNullSafe(F.lit(done)))


def import_bookmarks(old: DataFrame, new: DataFrame, by_location: bool = True) -> DataFrame:
    """Bookmarks (id, book_id, chapter_id, paragraph, offset, ...) with those of ``new`` whose place (or id) is not there yet. Ids that clash with
    another place's are made anew from the place."""
    keys = ["book_id", "chapter_id", "paragraph", "offset"] if by_location else ["id"]
    fields = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("r")).select(*keys, "r.*").select(*old.columns)
    added = one.join(old.select(*keys), keys, "left_anti")
    if by_location:
        taken = old.select("id").withColumn("__taken", F.lit(True)).distinct()
        own = F.concat_ws("-", F.lit("b"), F.md5(F.concat_ws("|", *keys).cast("binary")))
        added = added.join(taken, "id", "left").withColumn("id", F.when(F.col("__taken"), own).otherwise(F.col("id"))).drop("__taken")
    return old.unionByName(added.select(*old.columns))


def toggle_bookmarks(bookmarks: DataFrame, taps: DataFrame, reach: int = 1) -> DataFrame:
    """Bookmarks (book_id, chapter_id, paragraph) after taps at places: a tap within ``reach`` paragraphs of bookmarks removes them, any other adds one.

    A tap is met with the places around it by equality, not by comparing ranges.
    """
    keys = ["book_id", "chapter_id"]
    near = taps.select(*keys, "paragraph").distinct().withColumn("at", F.explode(F.sequence(F.col("paragraph") - reach, F.col("paragraph") + reach)))
    hit = near.join(bookmarks.select(*keys, F.col("paragraph").alias("at")), [*keys, "at"])
    stay = bookmarks.select(*keys, "paragraph").join(near.select(*keys, F.col("at").alias("paragraph")), [*keys, "paragraph"], "left_anti")
    added = taps.select(*keys, "paragraph").distinct().join(hit.select(*keys, "paragraph"), [*keys, "paragraph"], "left_anti")
    return stay.unionByName(added)


def in_request_order(requests: DataFrame) -> DataFrame:
    """The most urgent first, then in the order in which they came."""
    return requests.orderBy(F.col("priority").desc(), "sequence")
