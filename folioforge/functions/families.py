"""Families of sites: which ids are theirs, and what their addresses say and look like."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let
from .urls import parts

NUMBER = "[1-9][0-9]{0,8}"


@dataclass(frozen=True)
class Family:
    """Ids are ``prefix`` and a number. Addresses are paths with {book} and {chapter}; ``books`` and ``chapters`` are patterns of paths, of which
    group 1 is the book's number and group 2 the chapter's; ``cover`` may have {thousand}, the number by a thousand."""

    name: str
    prefix: str
    hosts: tuple[str, ...]
    books: tuple[str, ...]
    chapters: tuple[str, ...]
    info: str
    chapter: str
    cover: str = ""
    #: How its books are read: "online", chapter by chapter, or "download", as a whole.
    mode: str = "online"

    def is_id(self, book_id: Column) -> Column:
        return F.coalesce(book_id.rlike(rf"\A{self.prefix}{NUMBER}\z"), F.lit(False))

    def number(self, book_id: Column) -> Column:
        return F.when(self.is_id(book_id), F.substring(book_id, F.lit(len(self.prefix) + 1), F.length(book_id)))

    def _filled(self, template: str, book_id: Column, chapter_id: Column | None = None) -> Column:
        out = F.replace(F.lit(template), F.lit("{book}"), self.number(book_id))
        out = F.replace(out, F.lit("{thousand}"), F.floor(self.number(book_id).cast("long") / 1000).cast("string"))
        return out if chapter_id is None else F.replace(out, F.lit("{chapter}"), F.when(chapter_id.rlike(r"\A[0-9]{1,12}\z"), chapter_id))

    def info_url(self, book_id: Column) -> Column:
        """Null for ids of other families, as for the other addresses."""
        return self._filled(self.info, book_id)

    def cover_url(self, book_id: Column) -> Column:
        return self._filled(self.cover, book_id)

    def chapter_url(self, book_id: Column, chapter_id: Column) -> Column:
        return self._filled(self.chapter, book_id, chapter_id)

    def path(self, href: Column) -> Column:
        """The path of a link within the family's hosts; null for other hosts and for relative links that don't start at the root."""

        def within(own: Column) -> Column:
            return F.when((own["host"].isNull() & own["scheme"].isNull()) | F.lower(own["host"]).isin(*self.hosts), F.when(own["path"].startswith("/"), own["path"]))

        def path(link: Column) -> Column:
            # What starts at the root has neither scheme nor host, and is most of what pages hold.
            found, rooted = parts(link), F.regexp_extract(link, r"\A(/[^?#]*)(?:\?[^#]*)?(?:#.*)?\z", 1)
            whole = let(F.struct(found["scheme"].alias("scheme"), found["host"].alias("host"), found["path"].alias("path")), within)
            return F.when(link.startswith("/") & ~link.startswith("//"), F.when(rooted != "", rooted)).otherwise(whole)

        return let(F.trim(href), path)

    def chapter_link(self, book_id: Column, href: Column) -> Column:
        """The chapter's number of a link to a chapter of that book; null for all others."""

        def found(path: Column) -> Column:
            out = F.lit(None).cast("string")
            for p in reversed(self.chapters):
                out = F.when(F.regexp_extract(path, p, 1) == self.number(book_id), F.regexp_extract(path, p, 2)).otherwise(out)
            return out

        return let(self.path(href), found)

    def reference(self, path: Column) -> Column:
        """struct(book_id, chapter_id) of the path of a book's or a chapter's page."""
        out = F.lit(None).cast("struct<book_id:string,chapter_id:string>")
        for p in reversed(self.books):
            out = F.when(path.rlike(p), F.struct(F.concat(F.lit(self.prefix), F.regexp_extract(path, p, 1)).alias("book_id"), F.lit(None).cast("string").alias("chapter_id"))).otherwise(out)
        for p in reversed(self.chapters):
            out = F.when(path.rlike(p), F.struct(F.concat(F.lit(self.prefix), F.regexp_extract(path, p, 1)).alias("book_id"), F.regexp_extract(path, p, 2).alias("chapter_id"))).otherwise(out)
        return out


def route(book_id: Column, families: list[Family]) -> Column:
    """The name of the family that an id belongs to; null if there is none."""
    return F.coalesce(*[F.when(f.is_id(book_id), F.lit(f.name)) for f in families])


def is_mode(book_id: Column, families: list[Family], mode: str) -> Column:
    """Whether an id is of a family whose books are read in that mode; imported books and unknown ids are of none."""
    return F.coalesce(*[F.when(f.is_id(book_id), F.lit(f.mode == mode)) for f in families], F.lit(False))


def is_stored_book(book_id: Column, families: list[Family]) -> Column:
    """Whether a book's chapters are all in the store: imported ones and those that are downloaded as a whole."""
    return F.coalesce(book_id.rlike(r"\Alocal-[a-z0-9]{1,24}\z"), F.lit(False)) | is_mode(book_id, families, "download")


def pasted_reference(text: Column, families: list[Family]) -> Column:
    """struct(book_id, chapter_id) of an address that somebody pasted, with or without its scheme; null for anything but a book's or chapter's page of
    a family, for texts over 300 characters and for those with white space inside."""
    raw = F.trim(text)
    full = F.when(raw.rlike(r"(?i)\Ahttps?://"), raw).when(raw.rlike(r"(?i)\A(?:www\.)?[a-z0-9.-]+\.[a-z]{2,}/"), F.concat(F.lit("https://"), raw))
    own = parts(F.when((F.length(raw) <= 300) & ~raw.rlike(r"\s"), full))
    return F.coalesce(*[F.when(F.lower(own["host"]).isin(*f.hosts), f.reference(own["path"])) for f in families])


def placeholder_title(book_id: Column, families: list[Family], plain: str = "") -> Column:
    """A title for a book of which only the id is known: its family's name and number, or the id."""
    named = F.coalesce(*[F.when(f.is_id(book_id) & F.lit(f.name != plain), F.concat(F.lit(f.name + " "), f.number(book_id))) for f in families])
    return F.coalesce(named, F.concat(F.lit("书号 "), book_id))
