"""Cleaning of paragraphs: watermarks and advertising go, sentences cut by a page break are joined again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import trim, utf16_length
from ..functions.text import count_chars

# Whole-line rules look at short lines only; patterns in Java syntax.
SHORT = 80
PAGE_BREAK = r"\A[^\p{L}\p{N}]*(?:本小?章节?(?:还|尚)?未完|请?点击下一页|请翻页)"
JUNK_LINES = (
    r"\A[(（]?本章完[)）]?\z",
    r"\A[(（]?未完待续",
    r"如有问题请点击此处反馈",
    r"本章节内容正在手打中",
    r"天才一秒记住|一秒记住[【\[『「：:，,]|无弹窗|最新网址|网址发布页|请记住本(?:书|站)",
    r"最新章节",
    r"章节错误.{0,6}(?:点此|报送|举报)",
    r"(?:手机|移动)(?:用户|版|阅读)请?(?:访问|浏览|阅读|地址)",
    r"[(（]\s*[)）]\s*\S{0,16}(?:小说网|书城|中文网)\s*\z",
)
INLINE_JUNK = (
    r"(?s)<!--.*?-->",
    r"(?i)</?[a-z][a-z0-9]*(?:[\s=/][^<>]*)?>",
    r"(?i)[【\[［(（][^【】\[\]［］()（）]{0,12}(?:www|ｗｗｗ|https?:)[^【】\[\]［］()（）]{0,40}[】\]］)）]",
    r"(?i)(?:https?://|www[.．])[\w.．\-/?=&%#]*",
    r"本文由\S{1,24}?首发",
    r"顶点更新最快|首发哦亲|[@·\s]*无错首发[~～]*",
    r"[（(]?笔趣阁\w*[）)]?",
)
SUSPECT = r"(?i)[<&]|www|ｗｗｗ|https?:|首发|笔趣阁|更新最快"
# amp comes last: a text is decoded once.
ENTITIES = (("nbsp", " "), ("emsp", " "), ("ensp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&"))
OPEN_END = r"[，、,；;：:]\z"
EMPTY_NOTE = "（本章在来源中没有正文）"


def strip_inline(text: Column) -> Column:
    """The text without watermarks, markup remains and outer white space; cheap for texts that hold nothing suspect."""
    return F.when(text.rlike(SUSPECT), F.transform(F.array(trim(text)), _without_junk)[0]).otherwise(trim(text))


def _without_junk(own: Column) -> Column:
    changed = own
    for pattern in INLINE_JUNK:
        changed = F.regexp_replace(changed, pattern, "")
    for name, char in ENTITIES:
        changed = F.regexp_replace(changed, f"(?i)&{name};", char)
    tidy = lambda new: F.when(new == own, own).otherwise(trim(F.regexp_replace(new, r"[ \t]{2,}", " ")))
    return F.transform(F.array(changed), tidy)[0]


def kind_of(line: Column) -> Column:
    """kept, break or junk for a stripped line; junk if it is empty."""
    # Code points are no more than UTF-16 units, so the cheap length settles most lines.
    short = (F.length(line) <= SHORT) & (utf16_length(line) <= SHORT)
    return F.when(line == "", "junk").when(short & line.rlike(PAGE_BREAK), "break").when(short & line.rlike("|".join(f"(?:{p})" for p in JUNK_LINES)), "junk").otherwise("kept")


def clean_paragraphs(lines: DataFrame, keys: list[str], pos: str = "pos", text: str = "text") -> DataFrame:
    """keys, pos (of the first line), text: cleaned paragraphs of rows (keys, pos, text).

    A kept line continues the one before iff a page break lies between and that one ends with an open mark. Groups that had text but
    keep none get one note; groups without text give no rows.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = lines.select(*keys, F.col(pos).alias("pos"), strip_inline(F.col(text)).alias("line"), (trim(F.col(text)) != "").alias("had")).withColumn("kind", kind_of(F.col("line")))
    kept = F.col("kind") == "kept"
    own = own.withColumn("previous", F.last(F.when(kept, F.struct("pos", "line")), ignorenulls=True).over(before)).withColumn("broken", F.max(F.when(F.col("kind") == "break", F.col("pos"))).over(before))
    joins = (F.col("broken") > F.col("previous.pos")) & F.col("previous.line").rlike(OPEN_END)
    own = own.withColumn("island", F.sum(F.when(kept & ~F.coalesce(joins, F.lit(False)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = own.filter(kept).groupBy(*keys, "island").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("text"))
    empty = own.groupBy(*keys).agg(F.bool_or("had").alias("had"), F.bool_or(kept).alias("kept"), F.min("pos").alias("pos")).filter("had and not kept")
    return whole.select(*keys, "pos", "text").unionByName(empty.select(*keys, "pos", F.lit(EMPTY_NOTE).alias("text")))


def clean_array(paragraphs: Column) -> Column:
    """The same on one row: an array of paragraphs to an array of cleaned ones.

    Lines are stripped and judged once each. Texts without a page break, which are the many, are then done; the fold that joins lines
    copies an array per line.
    """
    judged = F.filter(F.transform(F.transform(paragraphs, strip_inline), lambda line: F.struct(line.alias("line"), kind_of(line).alias("kind"))), lambda x: x["kind"] != "junk")
    return F.transform(F.array(judged), lambda all_: _joined(all_, paragraphs))[0]


def _joined(lines: Column, paragraphs: Column) -> Column:
    """Kept lines and breaks to paragraphs: a kept line goes on with the one before iff a break stands between and that one ends with an open mark."""
    any_break = F.exists(lines, lambda p: p["kind"] == "break")
    plain = F.transform(lines, lambda p: p["line"])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("broken"))

    def step(acc: Column, p: Column) -> Column:
        line, is_break = p["line"], p["kind"] == "break"
        goes_on = acc["broken"] & F.coalesce(acc["last"].rlike(OPEN_END), F.lit(False))
        out = F.when(is_break, acc["out"]).when(goes_on, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(F.concat(F.element_at(acc["out"], -1), line)))).otherwise(F.concat(acc["out"], F.array(line)))
        return F.struct(out.alias("out"), F.when(is_break, acc["last"]).otherwise(line).alias("last"), is_break.alias("broken"))

    # Most texts have no page break: their kept lines are the result as they stand.
    found = F.when(any_break, F.aggregate(lines, start, step, lambda a: a["out"])).otherwise(plain)
    return F.when((F.size(found) == 0) & F.exists(paragraphs, lambda p: trim(p) != ""), F.array(F.lit(EMPTY_NOTE))).otherwise(found)


def read_view(chapters: DataFrame, paragraphs: str = "paragraphs") -> DataFrame:
    """Stored chapters as they are read: cleaned paragraphs and their char_count; what is stored stays as it is."""
    return chapters.withColumn(paragraphs, clean_array(F.col(paragraphs))).withColumn("char_count", count_chars(F.col(paragraphs)))


def is_empty_chapter(paragraphs: Column) -> Column:
    """Whether a chapter has no paragraphs, or none that cleaning leaves."""
    cleaned = clean_array(paragraphs)
    return (F.size(paragraphs) == 0) | (F.size(cleaned) == 0) | ((F.size(cleaned) == 1) & (F.element_at(cleaned, 1) == EMPTY_NOTE))
