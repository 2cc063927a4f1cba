"""Chapter titles: numbers written in Chinese numerals, normal forms, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE, collapse

# Numerals and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
NUMERALS = "零〇一二三四五六七八九十百千万两"


def chinese_number(text: Column) -> Column:
    """The value of decimal digits or Chinese numerals; null for anything else and for nothing."""
    digit = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("number"))

    def step(acc: Column, ch: Column) -> Column:
        u = unit[ch].cast("long")
        whole = (acc["section"] + acc["number"]) * u
        part = acc["section"] + F.when(acc["number"] == 0, F.lit(1)).otherwise(acc["number"]) * u
        return F.struct(
            F.when(u == 10000, acc["total"] + whole).otherwise(acc["total"]).alias("total"),
            F.when(u == 10000, F.lit(0).cast("long")).when(u.isNotNull(), part).otherwise(acc["section"]).alias("section"),
            F.when(u.isNotNull(), F.lit(0).cast("long")).otherwise(digit[ch].cast("long")).alias("number"),
        )

    value = F.aggregate(F.split(text, ""), start, step, lambda a: a["total"] + a["section"] + a["number"])
    return F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("long")).when(text.rlike(rf"\A[{NUMERALS}]+\z"), value)


def normal_title(title: Column) -> Column:
    """struct(display_title, number, extra) of a raw chapter title."""
    t = F.regexp_replace(collapse(title), r"\A[0-9]{1,4}[\s.、，]+(?=第)", "")
    section = F.regexp_extract(t, r"\A分节阅读第([0-9]+)节\z", 1)
    chapter = F.regexp_extract(t, rf"\A第([{NUMERALS}]+|[0-9]+)[章回掌][\s　]*(.*)\z", 1)
    bare = chinese_number(F.nullif(F.regexp_extract(t, rf"\A第([{NUMERALS}]+)[\s　]+(\S.*)\z", 1), F.lit("")))
    side = F.regexp_extract(t, rf"\A番外第([{NUMERALS}0-9]+)章", 1)
    is_side = t.startswith("番外")
    number = (
        F.when(section != "", section.try_cast("long"))
        .when(chapter != "", chinese_number(chapter))
        .when(bare > 0, bare)
        .when(is_side, chinese_number(F.nullif(side, F.lit(""))))
    )
    shown = F.when(section != "", F.concat(F.lit("第"), section.try_cast("long").cast("string"), F.lit("章"))).otherwise(t)
    return F.struct(shown.alias("display_title"), number.alias("number"), (is_side & (section == "") & (chapter == "")).alias("extra"))


def rest_title(title: Column, display_title: Column) -> Column:
    """What follows the chapter number; empty for placeholders."""
    pattern = rf"\A第[0-9{NUMERALS}]+章[\s　]*(.*)\z"
    return F.when(F.trim(title).rlike(r"\A分节阅读第[0-9]+节\z"), F.lit("")).when(display_title.rlike(pattern), F.regexp_extract(display_title, pattern, 1)).otherwise(display_title)


def title_key(title: Column, dropped: str = f"[{SPACE}]") -> Column:
    """A title without the characters of a class, for comparing titles of different origins."""
    return F.lower(F.regexp_replace(title, dropped, ""))


def is_promotion(title: Column) -> Column:
    return title.startswith("新书") | (F.contains(title, F.lit("新书")) & (F.length(title) <= 12))
