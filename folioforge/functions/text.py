"""Scalar functions on text: entities, tags, cleaning, sizes, labels."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import SPACE, collapse, trim, utf16_length
from .folds import let, replaced

# The named entities that are decoded; all others stay as they are.
ENTITIES = "amp lt gt quot apos nbsp ldquo rdquo mdash hellip emsp ensp thinsp middot lsquo rsquo".split()
ENTITY = "&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);"
MOST_POINT = 0x10FFFF


def _entity(match: Column) -> Column:
    """What an entity stands for; itself if it is unknown or no character."""
    hexadecimal, decimal = F.regexp_extract(match, "(?i)^&#x([0-9a-f]+);", 1), F.regexp_extract(match, "^&#([0-9]+)", 1)
    # Longer numbers are no characters, and would not fit.
    digits = F.when(hexadecimal != "", F.regexp_replace(hexadecimal, "^0+(?=.)", "")).when(decimal != "", F.regexp_replace(decimal, "^0+(?=.)", ""))
    point = F.when(F.length(digits) <= 8, F.when(hexadecimal != "", F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
    # Halves of surrogate pairs are no characters on their own.
    valid = point.between(0, 0xD7FF) | point.between(0xE000, MOST_POINT)
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    named = F.create_map(*[F.lit(x) for name in ENTITIES for x in (f"&{name};", html.unescape(f"&{name};"))])
    return F.coalesce(F.when(F.startswith(match, F.lit("&#")), F.when(valid, char)).otherwise(F.try_element_at(named, match)), match)


def decode_entities(text: Column) -> Column:
    """Decimal, hexadecimal and the named entities, each decoded once; null stays null."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), replaced(t, ENTITY, _entity)).otherwise(t))


def strip_tags(markup: Column) -> Column:
    """Line breaks and paragraph ends become line ends; all other tags go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\s*/?>", "\n"), r"(?i)</p\s*>", "\n"), "<[^>]+>", "")


def tidy_lines(text: Column) -> Column:
    """Collapsed lines without the empty ones."""
    split = F.split(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"\r\n?", "\n"), "\n", -1)
    return F.array_join(F.filter(F.transform(split, lambda line: F.trim(F.regexp_replace(line, "[ \\t\u3000]+", " "))), lambda line: line != ""), "\n")


def clean_text(markup: Column) -> Column:
    """Tags go first, then entities are decoded, then lines are tidied."""
    return tidy_lines(decode_entities(strip_tags(markup)))


def text_of(markup: Column) -> Column:
    """The text of a fragment on one line."""
    return F.trim(F.regexp_replace(clean_text(markup), "\n+", " "))


def from_base64(text: Column) -> Column:
    """UTF-8 text of base64 with any white space in it; null if it is invalid."""
    return F.decode(F.try_to_binary(F.regexp_replace(text, r"\s+", ""), F.lit("base64")), "UTF-8")


def count_chars(paragraphs: Column) -> Column:
    """UTF-16 units of all paragraphs."""
    return F.aggregate(F.transform(paragraphs, utf16_length), F.lit(0).cast("long"), lambda total, n: total + n)


def utf8_size(paragraphs: Column) -> Column:
    return F.octet_length(F.array_join(paragraphs, "")).cast("long")


def excerpt(text: Column, limit: int) -> Column:
    own = collapse(text)
    return F.when(F.length(own) > limit, F.concat(F.left(own, F.lit(limit)), F.lit("…"))).otherwise(own)


def format_bytes(n: Column) -> Column:
    k = n.cast("double") / 1024
    return F.when(n < 1024, F.format_string("%d B", n)).when(k < 1024, F.format_string("%.1f KB", k)).otherwise(F.format_string("%.1f MB", k / 1024))


def format_time(ms: Column, now_ms: Column) -> Column:
    """Hours and minutes on the same day, month and day in the same year, else the whole date."""
    at, now = F.timestamp_millis(ms), F.timestamp_millis(now_ms)
    return F.when(F.to_date(at) == F.to_date(now), F.date_format(at, "HH:mm")).when(F.year(at) == F.year(now), F.date_format(at, "MM-dd HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def title_without_page(title: Column) -> Column:
    return collapse(F.regexp_replace(title, r"[（(]第\d+页[）)]", ""))


def cover_text(title: Column) -> Column:
    return F.left(F.regexp_replace(title, f"[{SPACE}]+", ""), F.lit(4))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, given as seconds or as an HTTP date; null if it is neither."""
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(F.when(header.rlike(r"^\s*\d+\s*$"), F.trim(header).try_cast("long")), F.when(date.isNotNull(), F.greatest(F.unix_timestamp(date) - F.unix_timestamp(now), F.lit(0))))


def backoff_ms(attempt: Column, first: int = 400, most: int = 4000) -> Column:
    """Milliseconds before a retry, without jitter."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2), attempt)).cast("long")


def search_query(text: Column) -> Column:
    """A collapsed query of 1 to 30 code points; null for others and for control characters."""
    own = collapse(text)
    return F.when(~text.rlike(r"[\x00-\x1f\x7f]") & F.length(own).between(1, 30), own)


def size_estimate_mb(said: Column) -> Column:
    """Megabytes of a book of so many characters, said as a number or in ten thousands (万): 0.9 MB per million; null for anything else."""
    number = F.regexp_extract(said, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    chars = number * F.when(F.contains(said, F.lit("万")), 10_000).otherwise(1)
    return chars / 1_000_000 * 0.9


# What introductions say that is not about the book.
INTRO_BOILERPLATE = (r"(?s)三秒记住本站.*\z", r"[^。！？\n]*免费提供[^。！？\n]*[。！？]?", r"如果您喜欢[^，,]*[，,]别忘记分享给朋友[.。…]*", r"\A关于[^：:]{1,40}[：:]")
#: The same of pages that send markup as text and praise every book.
PRAISE = (r"(?i)<br\s*/?>", "<[^>]+>", r"[^。！？\n]*(?:最新章节由网友提供|情节跌宕起伏、扣人心弦)[^。！？\n]*[。！？]?")


def clean_intro(intro: Column, title: Column, boilerplate: tuple[str, ...] = INTRO_BOILERPLATE) -> Column:
    """An introduction without boilerplate; empty if nothing but the title is left."""
    own = intro
    for pattern in boilerplate:
        own = F.regexp_replace(own, pattern, " " if pattern == PRAISE[0] else "")
    own = trim(own)
    return F.when(own.eqNullSafe(title), F.lit("")).otherwise(own)


def short_title(display_title: Column, extra: Column, numerals: str = "零〇一二三四五六七八九十百千万两") -> Column:
    """A title without its chapter number; 正文 if it has nothing else; extras stay as they are."""
    pattern = rf"\A第[0-9{numerals}]+章[\s　]*(.*)\z"
    rest = F.coalesce(F.nullif(F.regexp_extract(display_title, pattern, 1), F.lit("")), F.lit("正文"))
    return F.when(~extra & display_title.rlike(pattern), rest).otherwise(display_title)


def ordinal(number: Column, extra: Column) -> Column:
    """What stands before a title in a list: 番外 for extras, the number, or a dot."""
    return F.when(extra.isNull(), F.lit("")).when(extra, F.lit("番外")).otherwise(F.coalesce(number.cast("string"), F.lit("·")))


def chapter_label(display_title: Column, chapter_id: Column) -> Column:
    return F.coalesce(display_title, F.concat(F.lit("章节 "), chapter_id), F.lit("未知章节"))
