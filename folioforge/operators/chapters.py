"""Assembly of chapters from their pages, with proof that they are complete."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_PAGES = 40
_PAGE_TITLE = re.compile(r"第\d+页")
_NAMES = ("book_id", "chapter_id", "title", "paragraphs", "prev_id", "next_id", "page_count", "char_count", "complete", "missing", "restricted")
_TYPES = pa.schema(list(zip(_NAMES, [*[pa.string()] * 3, pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.bool_()], strict=True)))
SCHEMA = "book_id string, chapter_id string, title string, paragraphs array<string>, prev_id string, next_id string, page_count int, char_count long, complete boolean, missing array<int>, restricted boolean"


def _answers(pages: dict[int, dict], reached: list[int]) -> dict[int, str]:
    """What each reached page turns out to be, in order of visits: text, absent or failed. A page that repeats a text or says that it is an
    earlier one shows that there is none at its place."""
    texts, out = set(), {}
    for at in reached:
        page = pages.get(at)
        text = tuple(page["paragraphs"]) if page and page["outcome"] not in ("failed", "not_found") else ()
        if page and page["outcome"] == "not_found":
            out[at] = "absent"
        elif not text:
            out[at] = "failed"
        elif text in texts or (page["declared_page"] is not None and page["declared_page"] < at):
            out[at] = "absent"
        else:
            texts.add(text)
            out[at] = "text"
    return out


def _closure(pages: dict[int, dict], start: list[int]) -> list[int]:
    """Pages that links lead to from ``start`` on, the smallest open one first; no more once MOST_PAGES have text."""
    order: list[int] = []
    open_ = set(start)
    while open_ and sum(kind == "text" for kind in _answers(pages, order).values()) < MOST_PAGES:
        order.append(min(open_))
        page = pages.get(order[-1])
        linked = page["same_pages"] if page and page["outcome"] not in ("failed", "not_found") and page["paragraphs"] else ()
        open_ = (open_ | {k for k in linked if 0 <= k < MOST_PAGES}) - set(order)
    return order


def _proved(pages: dict[int, dict], answers: dict[int, str]) -> bool:
    """Whether the last page with text is the chapter's last: it leads on to another chapter, or no page is at the place after it."""
    last = max(at for at, kind in answers.items() if kind == "text")
    return (pages[last]["next_id"] is not None and last > 0) or answers.get(last + 1) == "absent"


def _visit(pages: dict[int, dict]) -> tuple[dict[int, dict], set[int], bool]:
    """Pages that count, pages that are missing, and whether the end is proved: the closure of page 0 over links, and one probe past the
    last page if that proves nothing."""
    order = _closure(pages, [0])
    answers = _answers(pages, order)
    texts = {at for at, kind in answers.items() if kind == "text"}
    end = bool(texts) and _proved(pages, answers)
    probe = next((k for k in range(max(texts, default=0) + 1, MOST_PAGES) if k not in answers), None)
    if texts and not end and probe is not None and len(texts) < MOST_PAGES:
        answers = _answers(pages, order + [k for k in _closure(pages, [0, probe]) if k not in order])
        texts = {at for at, kind in answers.items() if kind == "text"}
        end = _proved(pages, answers)
    linked = {k for at in answers if pages.get(at) and pages[at]["outcome"] not in ("failed", "not_found") and pages[at]["paragraphs"] for k in pages[at]["same_pages"] if k < MOST_PAGES}
    missing = {at for at, kind in answers.items() if kind == "failed"} | {k for k in linked if answers.get(k) not in ("text", "absent")}
    return {at: pages[at] for at in texts}, missing, end and len(texts) < MOST_PAGES


def _assembled(fetched: dict[int, dict], any_repeat: bool) -> list[str]:
    out: list[str] = []
    for at in sorted(fetched):
        for k, p in enumerate(fetched[at]["paragraphs"]):
            if out and out[-1] == p and (any_repeat or k == 0):
                continue
            out.append(p)
    return out


def _whole(key: tuple[str, str], pages: dict[int, dict], any_repeat: bool) -> dict:
    """The row of SCHEMA of one chapter's pages."""
    fetched, missing, end = _visit(pages)
    own = dict(zip(_NAMES, (*key, None, [], None, None, 0, 0, False, sorted(missing), False), strict=True))
    if fetched:
        order = [fetched[k] for k in sorted(fetched)]
        text = _assembled(fetched, any_repeat)
        own |= {"title": next((p["title"] for p in order if not _PAGE_TITLE.search(p["title"] or "")), order[0]["title"]), "paragraphs": text, "prev_id": order[0]["prev_id"], "next_id": order[-1]["next_id"] or order[0]["next_id"]}
        own |= {"page_count": len(order), "char_count": sum(len(p.encode("utf-16-le", "surrogatepass")) // 2 for p in text), "complete": end and not missing, "restricted": any(bool(p["restricted"]) for p in order)}
    return own


def assemble(pages: DataFrame, any_repeat: bool = False) -> DataFrame:
    """Chapters of pages (book_id, chapter_id, page_index, outcome, title, paragraphs, prev_id, next_id, same_pages, declared_page, restricted).

    A paragraph that repeats the one before is dropped at a page's start only, or anywhere with ``any_repeat``. Pages lie in order of their chapters, and one pass
    takes chapter after chapter: it holds MOST_PAGES pages of one at most. Of rows of one page the first by outcome, title and paragraphs counts; null lists are
    empty; a chapter whose pages all have numbers beyond MOST_PAGES, or none, has none. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["book_id"], r["chapter_id"]) != key:
                    if key is not None:
                        out.append(_whole(key, own, any_repeat))
                    key, own = (r["book_id"], r["chapter_id"]), {}
                if r["page_index"] is not None and 0 <= r["page_index"] < MOST_PAGES:
                    own.setdefault(r["page_index"], r | {c: r[c] or [] for c in ("paragraphs", "same_pages")})
            yield pa.RecordBatch.from_pylist(out, _TYPES)
        if key is not None:
            yield pa.RecordBatch.from_pylist([_whole(key, own, any_repeat)], _TYPES)

    texts = [F.col(c).cast("string").alias(c) for c in ("book_id", "chapter_id")]
    own = pages.select(*texts, F.col("page_index").cast("int").alias("page_index"), "outcome", "title", "paragraphs", "prev_id", "next_id", "same_pages", "declared_page", "restricted")
    order = ["book_id", "chapter_id", "page_index", "outcome", "title", "paragraphs"]
    return own.repartition("book_id", "chapter_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def without_repeats(rows: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Rows without those whose value equals that of the row before."""
    order = Window.partitionBy(*keys).orderBy(pos)
    return rows.withColumn("__before", F.lag(value).over(order)).withColumn("__first", F.row_number().over(order) == 1).filter(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__before", "__first")


def signature_repeats(pages: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Pages with absent: whether an earlier page of the group has the same content."""
    order = Window.partitionBy(*keys, F.md5(F.col(value).cast("binary"))).orderBy(pos)
    return pages.withColumn("absent", F.row_number().over(order) > 1)
