"""Literal cases of contents, chapters and keyed state."""

import io
import zipfile

from pyspark.sql import functions as F

from folioforge.operators import chapters, search, segment, stores, toc
from folioforge.sources import archives, fetch_log


def merged(spark, rows):
    items = spark.createDataFrame([("1", 1, k, str(i), t) for k, (i, t) in enumerate(rows)], "book_id string, page int, pos int, id string, title string")
    return [r.id for r in toc.merge(toc.with_titles(items)).orderBy("order_key").collect()]


def test_merge_contents(spark):
    assert merged(spark, [(40000000, "第1章 甲"), (40000001, "第2章 乙"), (49000000, "第2章 乙")]) == ["40000000", "40000001"]
    assert merged(spark, [(49080153, "第5章 新"), (38626100, "分节阅读第5节"), (38626103, "第6章 丙")]) == ["49080153", "38626103"]
    assert merged(spark, [(49080154, "分节阅读第6节"), (38626103, "第6章 丙")]) == ["38626103"]
    assert merged(spark, [(58210332, "番外第一章 某"), (59040612, "番外第一章 某"), (1000, "第1章 甲"), (5, "新书推荐")]) == ["1000", "59040612"]
    assert merged(spark, [(10, "第3409章 x"), (11, "第3389章 y"), (12, "第3403章 z"), (13, "第3403章 w")]) == ["10", "11", "12", "13"]


def test_outliers(spark):
    rows = [("1", p, n) for p in (1, 2) for n in (1, 100, 101, 102, 500)]
    items = spark.createDataFrame(rows, "book_id string, page int, number int")
    got = sorted((r.page, r.number) for r in toc.without_outliers(items, ["book_id", "page"]).collect())
    assert got == [(1, 1), (1, 100), (1, 101), (1, 102), (1, 500), (2, 100), (2, 101), (2, 102)]


def test_contents_state(spark):
    rows = [("a", 1, "loaded", 2), ("a", 2, "loaded", 2), ("b", 1, "loaded", 3), ("b", 2, "failed", 3), ("c", 1, "loaded", 2), ("c", 2, "failed", 2), ("d", 1, "loading", 2)]
    got = {r.book_id: (r.state, r.next_page) for r in toc.page_state(spark.createDataFrame(rows, "book_id string, page int, status string, total_pages int")).collect()}
    assert got == {"a": ("complete", None), "b": ("partial", 3), "c": ("exhausted", None), "d": ("loading", 1)}


PAGE = "book_id string, chapter_id string, page_index int, outcome string, title string, paragraphs array<string>, prev_id string, next_id string, same_pages array<int>, declared_page int, restricted boolean"


def assembled(spark, pages, **more):
    rows = [("1", "9", k, o, t, p, pr, nx, s, d, False) for k, o, t, p, pr, nx, s, d in pages]
    return chapters.assemble(spark.createDataFrame(rows, PAGE), **more).first()


def test_chapters(spark):
    whole = [(0, "ok", "T（第1页）", ["a", "b"], "8", None, [1], None), (1, "ok", "T", ["b", "c", "c"], None, "10", [0], None)]
    r = assembled(spark, whole)
    assert (r.title, r.paragraphs, r.prev_id, r.next_id, r.page_count, r.char_count, r.complete, r.missing) == ("T", ["a", "b", "c", "c"], "8", "10", 2, 4, True, [])
    assert assembled(spark, whole, any_repeat=True).paragraphs == ["a", "b", "c"]
    loop = [(0, "ok", "T", ["a"], "8", "10", [], None), (1, "ok", "T", ["a"], None, None, [], 0)]
    r = assembled(spark, loop)
    assert (r.page_count, r.complete) == (1, True)
    gap = [(0, "ok", "T", ["a"], None, None, [1, 2], None), (1, "failed", None, None, None, None, None, None), (2, "ok", "T", ["c"], None, "10", [], None)]
    r = assembled(spark, gap)
    assert (r.paragraphs, r.complete, r.missing) == (["a", "c"], False, [1])
    assert assembled(spark, [(0, "failed", None, None, None, None, None, None)]).complete is False


def test_segments(spark):
    docs = spark.createDataFrame([(1, "front\r\n\r\n第一章 x\n p1 \n第二章 y\n第三章\np2"), (2, "第一章"), (3, None), (4, " ")], "doc_id int, text string")
    got = sorted((r.doc_id, r.chapter, r.title, r.paragraphs) for r in segment.split_chapters(docs).collect())
    assert got == [(1, 1, "正文", ["front"]), (1, 2, "第一章 x", ["p1"]), (1, 3, "第三章", ["p2"]), (2, 1, "第一章", [])]
    paragraphs = ["ab", "😀" * 7, "c" * 23, "d", "e" * 9]
    blocks = segment.build_blocks(spark.createDataFrame([(1, paragraphs)], "doc_id int, paragraphs array<string>"), size=9)
    assert segment.restore_paragraphs(blocks).first().paragraphs == paragraphs
    assert all(len(b.text.encode("utf-16-le")) <= 18 for b in blocks.collect())
    at = segment.anchors_to_blocks(spark.createDataFrame([(1, 2, 10), (1, 0, 1)], "doc_id int, paragraph int, offset int"), blocks)
    text = {b.block_index: b.text for b in blocks.collect()}
    assert {(r.paragraph, text[r.block_index][r.block_offset]) for r in at.collect()} == {(2, "c"), (0, "b")}
    lines = spark.createDataFrame([(1, 0, "a", True), (1, 1, "x", True), (1, 2, "c", True), (1, 3, "a", True)], "doc_id int, pos int, key string, unindented boolean")
    catalog = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")], "doc_id int, index int, key string")
    assert sorted((r.pos, r.catalog_index) for r in segment.align_to_catalog(lines, catalog).collect()) == [(0, 0), (2, 2)]


def test_state(spark):
    kind = "kind string, book_id string, id string, chapter_id string, updated_at long"
    old = spark.createDataFrame([("bookmark", "1", "a", "x", 5), ("history", "1", "h1", "c", 3), ("progress", "1", "p", "c", 7)], kind)
    new = spark.createDataFrame([("bookmark", "1", "a", "y", 9), ("history", "1", "h2", "c", 4), ("progress", "1", "q", "d", 7)], kind)
    once = stores.merge_personal(old, new)
    assert sorted(r.id for r in once.collect()) == ["a", "h2", "p"]
    assert sorted(map(tuple, stores.merge_personal(once, new).collect())) == sorted(map(tuple, once.collect()))
    books = spark.createDataFrame([("1",)], "book_id string")
    left = stores.delete_book({"chapters": old, "bookmarks": old}, books)
    assert left["chapters"].count() == 0 and left["bookmarks"].count() == 3
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, n int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 3)], "k int, v string, n int")
    assert sorted(map(tuple, stores.last_wins(a, b, ["k"]).collect())) == [(1, "x", 1), (2, "z", 2), (3, "w", 3)]
    assert sorted(map(tuple, stores.add_missing(a, b, ["k"]).collect())) == [(1, "x", 1), (2, "y", 1), (3, "w", 3)]


def test_places(spark):
    rows = spark.createDataFrame([(1, "😀Aba aBA"), (2, None)], "p int, text string")
    assert sorted((r.start, r.end) for r in search.match_places(rows, "aba", ["p"]).collect()) == [(2, 5), (6, 9)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("『书/作者:人』\n第一章 甲\n文\n".encode("gb18030"))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("empty.txt", "")
        z.writestr("b.txt", "第一章 乙\n字")
    (tmp_path / "b.zip").write_bytes(held.getvalue())
    (tmp_path / "c.zip").write_bytes(b"PK\x03\x04nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in archives.import_books(spark, str(tmp_path)).collect()}
    assert (got["a.txt"].title, got["a.txt"].author, got["b.zip"].title) == ("书", "人", "b")
    assert got["c.zip"].error and got["c.zip"].text is None
    found = archives.import_chapters(spark, str(tmp_path)).filter(F.col("title").startswith("第一章"))
    assert sorted(r.title for r in found.collect()) == ["第一章 乙", "第一章 甲"]


def test_fetch_log(spark):
    rows = [("https://a.b/1", 200, "text/html", b"ok", None), ("https://a.b/2", 404, None, b"", None), ("https://a.b/3", 503, "text/html", b"_cf_chl_opt", None), ("https://a.b/4", 500, None, b"", None), ("https://a.b/5", 200, "text/html", b"x", "https://z/"), ("https://a.b/6", 200, "image/png", b"x", None)]
    log = spark.createDataFrame(rows, "url string, status int, content_type string, body binary, final_url string")
    got = {r.url[-1]: (r["class"], r.outcome, r.retryable) for r in fetch_log.classified(log, ["a.b"]).collect()}
    assert got == {"1": ("ok", "ok", False), "2": ("http", "not_found", False), "3": ("blocked", "failed", False), "4": ("http", "failed", True), "5": ("redirected", "failed", False), "6": ("invalid", "failed", False)}
