"""Extraction from HTML by expressions; where elements nest, by the depth of their tags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let, running
from .text import decode_entities, text_of


#: Comments, scripts and styles.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def bare(fragment: Column) -> Column:
    """Without tags and outer blanks; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(fragment, "<[^>]+>", "")), F.lit(""))


def title(page: Column) -> Column:
    """The first heading of level one or two, else the title element; without tags, null if there is neither."""
    heading = F.regexp_extract(page, r"(?is)<h[12][^>]*>(.*?)</h[12]>", 1)
    named = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.coalesce(bare(heading), bare(named))


def meta(page: Column, name: str) -> Column:
    """The content of a meta element, whichever of its attributes comes first."""
    after = F.regexp_extract(page, rf'(?i)<meta[^>]*(?:property|name)="{re.escape(name)}"[^>]*content="([^"]*)"', 1)
    before = F.regexp_extract(page, rf'(?i)<meta[^>]*content="([^"]*)"[^>]*(?:property|name)="{re.escape(name)}"', 1)
    return decode_entities(F.coalesce(F.nullif(after, F.lit("")), F.nullif(before, F.lit(""))))


def anchors(page: Column) -> Column:
    """Array of struct(href, text) of links, in order; comments, scripts and styles are no source of links."""
    own = F.regexp_replace(page, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    pattern = r"""(?is)<a\s[^>]*?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))[^>]*>(.*?)</a>"""
    address = lambda x: F.concat(*[F.regexp_extract(x, pattern, k) for k in (1, 2, 3)])
    said = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_extract(x, pattern, 4), "<[^>]+>", ""), r"\s+", "")
    return F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(0)), lambda x: F.struct(address(x).alias("href"), said(x).alias("text")))


#: A link with an address in quotes (group 1) and what it holds (group 2).
LINK = r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""


def links(fragment: Column) -> Column:
    """Array of struct(href, text) of links with an address in quotes, in order; texts on one line, with their entities decoded."""
    found = F.regexp_extract_all(fragment, F.lit(LINK), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, LINK, 1).alias("href"), text_of(F.regexp_extract(x, LINK, 2)).alias("text")))


def total_pages(page: Column, book_id: Column | None = None) -> Column:
    """Pages of a book's contents (of any book's, without an id): by its page selector the largest numbered option and one, or 1 if that only has the first; else by the first link to a
    range of chapters; null if the page says nothing."""
    own = F.lit("[1-9][0-9]{0,8}") if book_id is None else book_id
    select = F.regexp_extract(page, r"(?is)<select.*?</select>", 0)
    options = F.regexp_extract_all(select, F.concat(F.lit("/book/"), own, F.lit(r"/([0-9]{1,9})\.html")), F.lit(1))
    first = select.rlike("(?i)<option") if book_id is None else F.regexp_count(select, F.concat(F.lit("/book/"), own, F.lit("/[\"']"))) > 0
    linked = F.regexp_extract_all(page, F.concat(F.lit("/book/"), own, F.lit(r"""/([0-9]{1,9})\.html["'][^>]*>第[0-9\-]+章""")), F.lit(1))
    return F.when(F.size(options) > 0, F.array_max(F.transform(options, lambda n: n.cast("int"))) + 1).when(first, F.lit(1)).otherwise(F.get(linked, F.lit(0)).cast("int") + 1)


#: Opening and closing tags of an element that nests.
TAG = r"(?i)</?{0}\b[^>]*>"


def _signs(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("</")), -1).otherwise(1))


def element_inner(page: Column, opening: str, name: str = "div") -> Column:
    """What the first element whose opening tag matches a pattern holds, nested ones of its kind included; to the end if it isn't closed; null without one.

    The depth behind each tag is a running sum; the element ends at the first tag behind which it is back at zero."""

    def inner(tags: Column, gaps: Column, at: Column) -> Column:
        own = F.slice(tags, at, F.size(tags))
        after = F.zip_with(running(_signs(own), F.lit(0), lambda a, x: a + x), _signs(own), lambda a, x: a + x)
        end = F.array_position(after, F.lit(0)).cast("int")
        n = F.when(end > 0, end).otherwise(F.size(own) + 1)  # pieces that lie within
        held = F.zip_with(F.slice(gaps, at + 1, n - 1), F.concat(F.slice(own, F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(F.lit(""))), lambda gap, tag: F.concat(gap, F.coalesce(tag, F.lit(""))))
        return F.array_join(held, "")

    pattern = TAG.format(name)
    tags = F.regexp_extract_all(page, F.lit(pattern), F.lit(0))
    first = lambda t: F.array_position(F.transform(t, lambda x: x.rlike(opening)), F.lit(True)).cast("int")
    return let(tags, lambda t: let(first(t), lambda at: F.when(at > 0, let(F.split(page, pattern, -1), lambda gaps: inner(t, gaps, at)))))


def div_inner(page: Column, attribute: str, value: str) -> Column:
    """``element_inner`` of the first div with that attribute value."""
    return element_inner(page, rf"""(?i)^<div\b[^>]*\b{attribute}\s*=\s*["'][^"']*\b{re.escape(value)}\b[^"']*["'][^>]*>""")


def without_divs(page: Column, attributes: str) -> Column:
    """The markup without divs whose attributes match a pattern (in any case), nested ones included; one that isn't closed goes to the end. A space stands for each."""
    pattern = TAG.format("div")

    def step(acc: Column, t: Column) -> Column:
        # depth: open divs of the one that goes; 0 outside.
        sign = F.when(F.startswith(t, F.lit("</")), -1).otherwise(1)
        goes = (sign == 1) & F.regexp_extract(t, r"(?i)^<div\b([^>]*)>", 1).rlike(f"(?i){attributes}")
        depth = F.when(acc["depth"] > 0, acc["depth"] + sign).when(goes, 1).otherwise(0)
        said = F.when(acc["depth"] > 0, F.lit("")).when(goes, F.lit(" ")).otherwise(t)
        return F.struct(depth.cast("int").alias("depth"), F.concat(acc["out"], F.array(F.struct(said.alias("tag"), (depth == 0).alias("stays")))).alias("out"))

    begin = F.struct(F.lit(0).alias("depth"), F.array().cast("array<struct<tag:string,stays:boolean>>").alias("out"))
    marked = lambda t: F.aggregate(t, begin, step, lambda acc: acc["out"])
    rest = lambda t, gaps: F.concat(F.get(gaps, F.lit(0)), F.array_join(F.zip_with(marked(t), F.slice(gaps, F.lit(2), F.size(t)), lambda m, gap: F.concat(m["tag"], F.when(m["stays"], gap).otherwise(""))), ""))
    tags = F.regexp_extract_all(page, F.lit(pattern), F.lit(0))
    return let(tags, lambda t: F.when(F.size(t) > 0, let(F.split(page, pattern, -1), lambda gaps: rest(t, gaps))).otherwise(page))


def paragraphs(page: Column) -> Column:
    """The texts of paragraph elements without tags and outer space, empty ones dropped."""
    raw = F.regexp_extract_all(page, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(raw, lambda p: F.trim(F.regexp_replace(p, "<[^>]+>", ""))), lambda p: p != "")
