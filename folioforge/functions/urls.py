"""Ids and addresses: validity, routing, parsing, building, allow-lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let

#: Patterns of book ids by the source that they route to, in order.
ROUTES = {"main": r"\A[1-9][0-9]{0,8}\z", "local": r"\Alocal-[A-Za-z0-9-]{1,40}\z"}


def route(book_id: Column, routes: dict[str, str] = ROUTES) -> Column:
    """The source of a book id; null for ids that no source has."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(routes.items()):
        out = F.when(book_id.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def is_chapter_id(chapter_id: Column) -> Column:
    return F.coalesce(chapter_id.rlike(r"\A[0-9]{1,12}\z"), F.lit(False))


def parts(url: Column) -> Column:
    """struct(scheme, user, host, port, path, query) by pattern: defined for any text, null where a part is absent."""
    pattern = r"\A(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:([^/?#@]*)@)?([^/?#:@]*)(?::([0-9]+))?)?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
    names = ["scheme", "user", "host", "port", "path", "query"]
    return F.struct(*[F.nullif(F.regexp_extract(url, pattern, k + 1), F.lit("")).alias(n) for k, n in enumerate(names)])


def is_allowed(url: Column, hosts: list[str], path: str = ".*") -> Column:
    """Web scheme, a listed host, the default port, a path of the given form, and nothing that could climb or hide in it."""
    p = parts(url)
    safe = ~url.rlike(r"(?i)\.\.|[^:]//|%2e|%2f|%5c|\\")
    return F.coalesce(p["scheme"].isin("http", "https") & p["user"].isNull() & F.lower(p["host"]).isin(hosts) & (p["port"].isNull() | p["port"].isin("80", "443")) & p["path"].rlike(rf"\A(?:{path})\z") & safe, F.lit(False))


def chapter_link(url: Column, book_id: Column) -> Column:
    """struct(chapter_id, page_index) of a link within a book: /book/B/C.html, /book/B/C_P.html or /book/B_C.html; null for others and for numbers of
    under six digits without a page in the first form, which are pages of a table of contents."""
    path = F.regexp_replace(F.trim(url), r"[?#].*\z", "")
    pattern = r"(?:\A|/)book/([0-9]+)(?:/([0-9]+)(?:_([0-9]{1,9}))?|_([0-9]+))\.html\z"

    def found(x: Column) -> Column:
        ok = (x["book"] == book_id) & ((x["short"] != "") | ((x["chapter"] != "") & ((F.length(x["chapter"]) >= 6) | (x["page"] != ""))))
        return F.when(ok, F.struct(F.concat(x["chapter"], x["short"]).alias("chapter_id"), F.coalesce(F.nullif(x["page"], F.lit("")).cast("int"), F.lit(0)).alias("page_index")))

    groups = lambda p: F.struct(*[F.regexp_extract(p, pattern, k + 1).alias(n) for k, n in enumerate(("book", "chapter", "page", "short"))])
    return let(path, lambda p: let(F.when(p.rlike(pattern), groups(p)), found))


def toc_url(base: str, book_id: Column, page: Column) -> Column:
    return F.when(page <= 1, F.concat(F.lit(f"{base}/book/"), book_id, F.lit("/"))).otherwise(F.concat(F.lit(f"{base}/book/"), book_id, F.lit("/"), (page - 1).cast("string"), F.lit(".html")))


def chapter_url(base: str, book_id: Column, chapter_id: Column, page: Column) -> Column:
    """Null for page numbers outside 0 to 39."""
    tail = F.when(page > 0, F.concat(F.lit("_"), page.cast("string"))).otherwise("")
    return F.when(page.between(0, 39), F.concat(F.lit(f"{base}/book/"), book_id, F.lit("/"), chapter_id, tail, F.lit(".html")))


def toc_range_is_valid(first: Column, last: Column, most: int = 999, span: int = 6) -> Column:
    """1 <= first <= last <= most, and no more than ``span`` pages."""
    return F.coalesce((first >= 1) & (first <= last) & (last <= most) & (last - first < span), F.lit(False))


def is_online(book_id: Column) -> Column:
    """Whether a book's chapters can be fetched: any source but the local one."""
    return F.coalesce(route(book_id) != "local", F.lit(False))
