"""Import of whole books into a store, all of a book or nothing.

A store is a folder of Parquet tables. Rows lie under the id of the import that wrote them and count for a book from the moment on when the log
says that this import of it is ready; before, and after a failure, nobody sees them. A failed import's folders are deleted.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import count_chars, utf8_size
from ..functions.titles import normal_title
from ..operators.books import TextRules, whole_books
from ..operators.segment import build_blocks, split_chapters
from .archives import import_books

IMPORTING, READY, FAILED = "IMPORTING", "READY", "FAILED"
NO_CHAPTERS = "no chapters recognised"
LOG = "book_id string, import_id string, status string, title string, author string, chapters int, missing int, bytes long, error string, at long"
TABLES = {
    "chapters": "book_id string, chapter_id string, position int, title string, paragraphs array<string>, char_count long, bytes long, prev_id string, next_id string, source string, complete boolean",
    "entries": "book_id string, order_key long, chapter_id string, title string, extra boolean, page int",
    "blocks": "book_id string, chapter_id string, block_index int, start_paragraph int, end_paragraph int, text string, offsets array<int>",
    "pages": "book_id string, page int, status string",
    "missing": "book_id string, index int, id string, title string",
}
PAGE = 100


def file_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]+\z", "")


def tables(chapters: DataFrame, missing: DataFrame) -> dict[str, DataFrame]:
    """The store's tables for chapters (book_id, chapter, chapter_id, title, paragraphs, last: how many the book has)."""
    at = F.col("chapter")
    # Ids are taken from the neighbours' rows where a catalog names them, else they are numbers.
    beside = chapters.select("book_id", at.alias("n"), F.col("chapter_id").alias("beside"))
    way = lambda step, name: beside.select("book_id", (F.col("n") - step).alias("chapter"), F.col("beside").alias(name))
    both = chapters.join(way(-1, "prev_id"), ["book_id", "chapter"], "left").join(way(1, "next_id"), ["book_id", "chapter"], "left")
    stored = both.select("book_id", "chapter_id", (at - 1).alias("position"), "title", "paragraphs", count_chars(F.col("paragraphs")).alias("char_count"), utf8_size(F.col("paragraphs")).alias("bytes"), "prev_id", "next_id", F.lit("local").alias("source"), F.lit(True).alias("complete"))
    entries = chapters.select("book_id", (at - 1).cast("long").alias("order_key"), "chapter_id", "title", normal_title(F.col("title"))["extra"].alias("extra"), (F.floor((at - 1) / PAGE) + 1).cast("int").alias("page"))
    key = F.to_json(F.struct("book_id", "chapter_id"))
    own = build_blocks(chapters.select(key.alias("key"), "paragraphs"), "key").withColumn("k", F.from_json("doc_id", "book_id string, chapter_id string"))
    blocks = own.select("k.book_id", "k.chapter_id", "block_index", "start_paragraph", "end_paragraph", "text", "offsets")
    pages = entries.select("book_id", "page", F.lit("LOADED").alias("status")).distinct()
    return {"chapters": stored, "entries": entries, "blocks": blocks, "pages": pages, "missing": missing}


def import_into(spark: SparkSession, paths: list[str] | str, store: str, catalog: DataFrame | None = None, book_id: Column | None = None, rules: TextRules = TextRules()) -> DataFrame:
    """The final log rows of an import of .txt and .zip files into ``store``; a book's id is ``book_id`` of its path, the file's name unless given.

    With a catalog (book_id, index, id, title) chapters follow it where it fits, else the usual headings begin them. A file that can't be read and one
    without chapters fail alone; an error of the run fails all of its books, whose former import stays as it was, and is raised again. Of files with one id the
    first by path counts.
    """
    import_id = uuid.uuid4().hex
    texts_at = f"{store}/texts/import_id={import_id}"
    log = lambda rows: rows.select(*[c.split()[0] for c in LOG.split(", ")]).coalesce(1).write.mode("append").parquet(f"{store}/imports")
    now = lambda: F.lit(time.time_ns() // 1_000_000)
    blank = lambda **said: {"import_id": F.lit(import_id), "chapters": F.lit(None).cast("int"), "missing": F.lit(None).cast("int"), "error": F.lit(None).cast("string"), "at": now()} | said
    try:
        found = import_books(spark, paths).withColumn("book_id", file_name(F.col("path")) if book_id is None else book_id)
        found.groupBy("book_id").agg(F.min_by(F.struct("title", "author", "text", "bytes", "error"), "path").alias("r")).select("book_id", "r.*").write.parquet(texts_at)
        texts = spark.read.schema("book_id string, title string, author string, text string, bytes long, error string").parquet(texts_at)
        log(texts.withColumns(blank(status=F.lit(IMPORTING))))
        try:
            good = texts.filter("error is null").select("book_id", "text")
            if catalog is None:
                split = split_chapters(good, "book_id").withColumnRenamed("doc_id", "book_id")
                chapters, missing = split.withColumn("chapter_id", F.col("chapter").cast("string")), spark.createDataFrame([], TABLES["missing"])
            else:
                chapters, _, missing = whole_books(good, catalog, rules)
            for name, rows in tables(chapters, missing).items():
                rows.write.parquet(f"{store}/{name}/import_id={import_id}")
            counts = _rows(spark, store, "entries", import_id).groupBy("book_id").agg(F.count("*").cast("int").alias("chapters"))
            lacking = _rows(spark, store, "missing", import_id).groupBy("book_id").agg(F.count("*").cast("int").alias("missing"))
            ended = texts.join(counts, "book_id", "left").join(lacking, "book_id", "left").withColumns({"import_id": F.lit(import_id), "at": now(), "missing": F.coalesce("missing", F.lit(0)), "chapters": F.coalesce("chapters", F.lit(0))})
            ended = ended.withColumn("error", F.when(F.col("error").isNull() & (F.col("chapters") == 0), F.lit(NO_CHAPTERS)).otherwise(F.col("error")))
            log(ended.withColumn("status", F.when(F.col("error").isNull(), READY).otherwise(FAILED)))
        except Exception as error:
            log(texts.withColumns(blank(status=F.lit(FAILED), error=F.lit(str(error)[:200]))))
            raise
    except Exception:
        for name in TABLES:
            _delete(spark, f"{store}/{name}/import_id={import_id}")
        raise
    finally:
        _delete(spark, texts_at)
    return states(spark, store).filter(F.col("import_id") == import_id)


def _rows(spark: SparkSession, store: str, name: str, import_id: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{store}/{name}/import_id={import_id}")


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def states(spark: SparkSession, store: str) -> DataFrame:
    """The last log row of each book and import."""
    rows = spark.read.schema(LOG).parquet(f"{store}/imports")
    return rows.groupBy("book_id", "import_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("book_id", "import_id")]), F.struct(F.col("status") != IMPORTING, "at")).alias("r")).select("book_id", "import_id", "r.*")


def ready(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The rows of one of the store's tables that count: those of each book's last import that is ready. Folders of other imports are not read."""
    last = states(spark, store).filter(F.col("status") == READY).groupBy("book_id").agg(F.max_by("import_id", F.struct("at", "import_id")).alias("import_id"))
    rows = spark.read.schema(f"{TABLES[name]}, import_id string").parquet(f"{store}/{name}")
    return rows.join(last, ["book_id", "import_id"], "left_semi").drop("import_id")
