"""Whole books from one text each: chapters by the book's catalog where that fits, by headings at the margin elsewhere.

A book's lines stay in its row. What travels are its lines at the margin whose words are in the catalog; an ordered pass over these
gives the places at which chapters begin, and the text is cut there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPACE, lines, trim, utf16_length
from ..functions.folds import exploded
from .clean import kind_of, strip_inline
from .segment import FRONT, LEAST_MATCHED, in_catalog_order


@dataclass(frozen=True)
class TextRules:
    """What whole texts look like. Patterns are for lines without outer white space: the line after which the book begins, lines of the template,
    advertising (in lines of ``advert_chars`` at most), and headings that may end a sentence."""

    # Patterns of the files' template.
    marker: str = r"\A-{3,}\s*章节内容开始\s*-{3,}\z"
    trailer: str = r"\A(?:=+\s*已完结\s*=+|『[^』]*』?)\z"
    numbered: str = r"\A第[零〇一二三四五六七八九十百千万两0-9]+[章节回卷]"
    advert: str = "(?!)"
    advert_chars: int = 120
    heading_chars: int = 40
    #: Entries of a catalog that a text may lack in a row.
    window: int = 200


LINE = "array<struct<line:string,inset:boolean>>"


def book_lines(text: Column, rules: TextRules = TextRules()) -> Column:
    """(line, inset) for the lines of a whole text behind its marker, or all without one: blank lines, advertising and lines of the template go; ``inset`` says
    whether white space stood before the line."""
    raw = F.transform(lines(text), lambda x: F.struct(trim(x).alias("line"), x.rlike(r"\A[ \t　]").alias("inset")))
    advert = lambda x: x["line"].rlike(rules.advert) & (utf16_length(x["line"]) <= rules.advert_chars)
    wanted = lambda x: (x["line"] != "") & ~x["line"].rlike(rules.trailer) & ~advert(x)
    begin = lambda a: F.array_position(F.transform(a, lambda x: x["line"].rlike(rules.marker)), F.lit(True)).cast("int")
    # Each is evaluated once for a text.
    behind = F.get(F.transform(F.array(raw), lambda a: F.slice(a, begin(a) + 1, F.size(a))), F.lit(0))
    return F.when(text.isNull(), F.array().cast(LINE)).otherwise(F.filter(behind, wanted))


def heading_key(line: Column) -> Column:
    return F.regexp_replace(line, f"[{SPACE}]+", "")


def is_heading(x: Column, rules: TextRules = TextRules()) -> Column:
    """A short line at the margin that isn't advertising and, unless it is numbered, doesn't end a sentence."""
    line = x["line"]
    return ~x["inset"] & (F.length(line) <= rules.heading_chars) & (~line.rlike(r"[。…]\z") | line.rlike(rules.numbered)) & (kind_of(strip_inline(line)) == "kept")


def whole_books(texts: DataFrame, catalog: DataFrame, rules: TextRules = TextRules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chapters, books, missing) of texts (book_id, text) and catalogs (book_id, index, id, title).

    A line at the margin that equals a title but for white space begins that entry's chapter, in the order of the catalog; other lines at
    the margin are text. A catalog that at least half of a text's lines at the margin follow counts: chapters have its ids and titles, lines
    before the first are dropped, chapters may be empty, and entries that no line matched are missing. Else headings at the margin begin chapters, with
    numbers as ids, and what stands before them is one of its own; nothing is missing then.

    chapters: book_id, chapter (from 1), chapter_id, title, paragraphs. books: book_id, matched, headings, aligned, chapters, for each book. missing: book_id,
    index, id, title. A book has one text and a catalog one entry of an index; null ids are left out, null texts and null titles have no lines.
    """
    own = texts.filter("book_id is not null").select("book_id", book_lines(F.col("text"), rules).alias("lines"))
    entries = catalog.filter("book_id is not null").select("book_id", F.col("index").cast("int").alias("index"), F.col("id").cast("string").alias("id"), "title")
    at_margin = exploded(own.select(F.col("book_id").alias("doc_id"), "lines"), "lines", "at", "x").filter("not x.inset").select("doc_id", "at", heading_key(F.col("x.line")).alias("key"))
    places = entries.filter("title is not null").groupBy(F.col("book_id").alias("doc_id"), heading_key(F.col("title")).alias("key")).agg(F.sort_array(F.collect_list("index")).alias("places"))
    matched = in_catalog_order(at_margin.join(places, ["doc_id", "key"]), rules.window).withColumnRenamed("doc_id", "book_id")
    begin = F.struct("at", "id", "title")
    plans = matched.join(entries, ["book_id", "index"]).groupBy("book_id").agg(F.sort_array(F.collect_list(begin)).alias("begins"))

    margin = F.size(F.filter("lines", lambda x: ~x["inset"]))
    both = own.join(plans, "book_id", "left").withColumn("headings", margin).withColumn("matched", F.coalesce(F.size("begins"), F.lit(0)))
    both = both.withColumn("matched", F.when(F.col("begins").isNull(), 0).otherwise(F.col("matched")))
    both = both.withColumn("aligned", (F.col("matched") > 0) & (F.col("matched") >= F.col("headings") * LEAST_MATCHED))
    said = F.filter(F.transform("lines", lambda x, k: F.struct(k.alias("at"), F.lit(None).cast("string").alias("id"), F.when(is_heading(x, rules), x["line"]).alias("title"))), lambda x: x["title"].isNotNull())
    both = both.withColumn("begins", F.when(F.col("aligned"), F.col("begins")).otherwise(said))
    first = F.get("begins", F.lit(0))
    front = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("id"), F.lit(FRONT).alias("title")))
    headless = ~F.col("aligned") & (F.size("lines") > 0) & (F.coalesce(first["at"], F.lit(1)) > 0)
    both = both.withColumn("begins", F.when(headless, F.concat(front, "begins")).otherwise(F.col("begins")))
    ends = F.concat(F.transform(F.slice("begins", F.lit(2), F.greatest(F.size("begins"), F.lit(1))), lambda x: x["at"]), F.array(F.size("lines")))
    cut = lambda b, end: F.struct(b["id"].alias("id"), b["title"].alias("title"), F.transform(F.slice("lines", b["at"] + 2, end - b["at"] - 1), lambda x: x["line"]).alias("paragraphs"))
    parts = F.when(F.size("begins") > 0, F.zip_with("begins", ends, cut))
    chapters = exploded(both.select("book_id", parts.alias("parts")), "parts", "k", "c")
    chapters = chapters.select("book_id", (F.col("k") + 1).alias("chapter"), F.coalesce("c.id", (F.col("k") + 1).cast("string")).alias("chapter_id"), "c.title", "c.paragraphs")
    books = both.select("book_id", "matched", "headings", "aligned", F.size("begins").alias("chapters"))
    missing = entries.join(books.filter("aligned").select("book_id"), "book_id", "left_semi").join(matched.select("book_id", "index"), ["book_id", "index"], "left_anti")
    return chapters, books, missing.select("book_id", "index", "id", "title")
