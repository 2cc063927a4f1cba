"""Literal cases of operators that no registered query can show in full."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import families, markup, text, urls
from folioforge.functions.families import NUMBER, Family
from folioforge.operators import chapters, parse, search, segment, statistics, stores, toc
from folioforge.sources import archives, codecs
from folioforge.streaming import flows

SITE = Family("north", "north-", ("n.example.com", "www.n.example.com"), (rf"\A/book/({NUMBER})(?:\.htm|/)?\z",), (rf"\A/txt/({NUMBER})/([0-9]{{1,12}})(?:\.html?)?/?\z",), "https://n.example.com/book/{book}.htm", "https://n.example.com/txt/{book}/{chapter}", "https://i.example.com/{thousand}/{book}s.jpg")


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_family_links(spark):
    hrefs = ["/txt/12/345", "https://n.example.com/txt/12/345.html?x#y", "//www.n.example.com/txt/12/345/", "/txt/13/345", "https://else.example.com/txt/12/345", "txt/12/345", "/book/12/", ""]
    got = values(spark, [(h,) for h in hrefs], "h string", SITE.chapter_link(F.lit("north-12"), F.col("h")))
    assert [g[0] for g in got] == ["345", "345", "345", None, None, None, None, None]
    pasted = ["n.example.com/book/7.htm", " https://n.example.com/txt/7/9 ", "https://n.example.com/", "two words n.example.com/book/7", "ftp://n.example.com/book/7", "x" * 301, None]
    got = values(spark, [(p,) for p in pasted], "p string", families.pasted_reference(F.col("p"), [SITE]))
    assert [g[0] and tuple(g[0]) for g in got] == [("north-7", None), ("north-7", "9"), None, None, None, None, None]
    got = values(spark, [("north-2345", "9"), ("2345", "9"), ("north-2345", "x")], "b string, c string", SITE.info_url(F.col("b")), SITE.cover_url(F.col("b")), SITE.chapter_url(F.col("b"), F.col("c")), families.placeholder_title(F.col("b"), [SITE]))
    assert got[0] == ("https://n.example.com/book/2345.htm", "https://i.example.com/2/2345s.jpg", "https://n.example.com/txt/2345/9", "north 2345")
    assert got[1] == (None, None, None, "书号 2345") and got[2][2] is None


def test_single_page_chapter(spark):
    page = """<title>第1章 起-书-站</title><div class="txtnav"><h1>第1章 起</h1><div class="txtinfo hide">时间 <div>x</div></div>第1章　起<br>&emsp;&emsp;第一段。<br/><div id="txtright">广告</div>　　第二段。<br>(本章完)</div>
    <a href="/txt/12/4">上一章</a><a href="/book/12/">目录</a><a href="/txt/12/6.html">下一章</a>"""
    docs = spark.createDataFrame([("north-12", "5", page), ("north-12", "6", "<p>none</p>")], "book_id string, chapter_id string, html string")
    rows = {r.chapter_id: r for r in parse.single_page_chapters(docs, SITE).collect()}
    assert (rows["5"].title, rows["5"].paragraphs, rows["5"].prev_id, rows["5"].next_id, rows["5"].complete) == ("第1章 起", ["第一段。", "第二段。"], "4", "6", True)
    assert not rows["6"].complete and not rows["6"].paragraphs and rows["6"].title == "章节 6"


def test_listed_results(spark):
    rows_page = """<ul id="novel-search"><li><span class="s1">[玄幻]</span><span class="s2"><a href="/book/12/">书 A</a></span><span class="s3">人</span><span class="s4">第9章</span><span class="s5">01-02</span></li>
    <li><span class="s2"><a href="/book/12/">again</a></span></li><li><span class="s2"><a href="/x">none</a></span></li></ul>"""
    docs = spark.createDataFrame([("q", rows_page), ("none", "没有找到"), ("odd", "<html/>")], "query string, html string")
    got = {r.query: r for r in parse.listed_results(docs, parse.ROWS).collect()}
    assert (got["q"].id, got["q"].title, got["q"].category, got["q"].author, got["q"].latest_chapter, got["q"].updated) == ("12", "书 A", "玄幻", "人", "第9章", "01-02")
    assert got["none"].recognised and got["none"].id is None and not got["odd"].recognised
    card = """<ul class="u-list"><li><h3 class="bname"><a href="/read/7/">书 B</a></h3><span class="bauthor">人</span><span class="end">完</span><span class="size">10万字</span><p class="l-p2">关于书：""" + "很" * 200 + """</p><span class="l-chapter">末</span></li></ul>"""
    r = parse.listed_results(spark.createDataFrame([("q", card)], "query string, html string"), parse.CARDS).first()
    assert (r.id, r.author, r.category, r.latest_chapter, r.intro) == ("7", "人", "完 · 10万字", "末", "很" * 160 + "…")


def test_without_divs(spark):
    got = values(spark, [("a<div class='ad'>b<div>c</div></div>d<div>e</div><DIV id=ads>f",), (None,)], "p string", markup.without_divs(F.col("p"), r"\bads?\b"))
    assert got == [("a d<div>e</div> ",), (None,)]


def test_alignment_with_a_catalog(spark):
    lines = spark.createDataFrame([(1, k, t, True) for k, t in enumerate(["a", "x", "c", "d"])] + [(2, 0, "q", True)], "doc_id long, pos int, key string, unindented boolean")
    catalog = spark.createDataFrame([(1, k, t) for k, t in enumerate("abcd")] + [(2, 0, "z")], "doc_id long, index int, key string")
    matches = segment.align_to_catalog(lines, catalog)
    books, missing = segment.aligned(matches, spark.createDataFrame([(1, 4), (2, 1)], "doc_id long, headings int"), catalog)
    assert sorted(map(tuple, books.collect())) == [(1, 3, 4, True), (2, 0, 1, False)]
    assert [tuple(r) for r in missing.collect()] == [(1, 1, "b")]


def test_split_by_margin(spark):
    said = "前言。\n第1章 起。\n　　第2章 不是标题\n天才一秒记住【站】\n标题\n　　正文。\n"
    docs = spark.createDataFrame([(1, said), (2, None), (3, " \n")], "doc_id long, text string")
    rows = sorted(map(tuple, segment.split_by_margin(docs).collect()))
    assert rows == [(1, 1, "正文", ["前言。"]), (1, 2, "第1章 起。", ["第2章 不是标题"]), (1, 3, "标题", ["正文。"])]


def test_contents_merge_once_and_by_source(spark):
    kind = "book_id string, page int, pos int, id string, title string"
    raw = spark.createDataFrame([("1", 1, 0, "100", "第1章 a"), ("1", 1, 1, "200", "第2章 b"), ("1", 2, 0, "300", "第3章 c"), ("1", 2, 1, "250", "番外 x")], kind)
    saved, new = toc.with_titles(raw), toc.with_titles(raw.filter("page = 2 and id <> '300'").union(spark.createDataFrame([("1", 2, 2, "310", "第3章 d")], kind)))
    got = [(r.order_key, r.id) for r in toc.merge_saved(saved, new).orderBy("order_key").collect()]
    assert got == [(0, "100"), (1, "200"), (2, "310"), (3, "250")]
    other = toc.with_titles(raw.withColumn("book_id", F.lit("n"))).unionByName(toc.with_titles(raw))
    both = toc.merge_by_source(other, F.when(F.col("book_id") == "n", "north").otherwise("main"))
    assert [(r.order_key, r.id) for r in both.filter("book_id = 'n'").orderBy("order_key").collect()] == [(0, "100"), (1, "200"), (2, "300"), (3, "250")]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")], "book_id string, chapter_id string, text string")
    stores.write(rows, f"{tmp_path}/s")
    stores.write(spark.createDataFrame([("a", "9", "w")], rows.schema), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.book_id, r.chapter_id) for r in back.collect()) == [("a", "9"), ("b", "1")]
    assert [tuple(r) for r in stores.read(rows, ["chapter_id"], book_id="a", chapter_id=["2", "7"]).collect()] == [("2",)]
    stay, n = stores.deleted(rows, spark.createDataFrame([("a", "1"), ("a", "1"), ("q", "1")], "book_id string, chapter_id string"), ["book_id", "chapter_id"])
    assert stay.count() == 2 and n.first().deleted == 1
    stored = spark.createDataFrame([("a", "local", 4), ("a", "remote", None), ("b", "remote", 3)], "book_id string, source string, v int")
    assert stores.without_remote(stored, spark.createDataFrame([("a",)], "book_id string")).count() == 2
    assert [r.book_id for r in stores.stale(stored).collect()] == ["a", "b"]
    assert values(spark, [(4, False, True), (4, False, None), (3, True, False)], "v int, l boolean, c boolean", stores.is_current(F.col("v"), F.col("l"), F.col("c"))) == [(True,), (False,), (True,)]
    marks = spark.createDataFrame([("m", "a", "1", 3, 0)], "id string, book_id string, chapter_id string, paragraph int, offset int")
    new = spark.createDataFrame([("m", "a", "1", 9, 0), ("k", "a", "1", 3, 0)], marks.schema)
    got = stores.import_bookmarks(marks, new).collect()
    assert len(got) == 2 and len({r.id for r in got}) == 2 and {r.paragraph for r in got} == {3, 9}
    assert stores.import_bookmarks(marks, new, by_location=False).count() == 2
    asked = spark.createDataFrame([(1, 5), (9, 2), (9, 1)], "priority int, sequence int")
    assert [r.sequence for r in stores.in_request_order(asked).collect()] == [1, 2, 5]


def test_repeated_new_rows_do_not_multiply(spark):
    old = spark.createDataFrame([(1, "a", 5, 1)], "k int, t string, char_count long, paragraph_count long")
    new = spark.createDataFrame([(1, " ", 6, 1), (1, "b", 9, 2), (2, "c", 1, 1)], old.schema)
    assert sorted((r.k, r.t) for r in stores.upsert_nonblank(old, new, ["k"]).collect()) == [(1, "b"), (2, "c")]
    assert sorted((r.k, r.t) for r in stores.never_shrink(old, new, ["k"]).collect()) == [(1, "b"), (2, "c")]


def test_search_by_pages(spark):
    book = spark.createDataFrame([("b", p, p * 10 + k, f"第{p * 10 + k}章", p * 10 + k, str(p * 1000 + k)) for p in range(1, 9) for k in range(10)], "book_id string, page int, pos int, title string, number int, id string")
    ranges = statistics.number_ranges(book).withColumn("total", F.lit(8))
    assert [r.pos for r in search.toc_search_by_pages(book, ranges, "35").collect()] == [35]
    assert [r.pos for r in search.toc_search_by_pages(book, ranges, "8003").collect()] == [83]
    assert search.toc_search_by_pages(book, ranges, "章").count() == 60


def test_statistics(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"], ["b"]), (2, None, ["x"]), (3, ["z"], None)], "k int, w array<string>, h array<string>")
    assert [r.missing for r in statistics.missing_of(rows, ["k"], "w", "h").orderBy("k").collect()] == [["a", "c"], [], ["z"]]
    got = statistics.outcome_counts(spark.createDataFrame([("x", "done"), ("x", "failed"), ("x", "done")], "f string, outcome string"), ["f"]).first()
    assert (got.done, got.skipped, got.failed, got.total) == (2, 0, 1, 3)
    assert tuple(statistics.store_size(rows.limit(0).withColumn("bytes", F.lit(1))).first()) == (0, 0)


@pytest.mark.parametrize(("ms", "want"), [(1_704_200_000_000, "12:53"), (1_704_100_000_000, "01-01 09:06"), (1_600_000_000_000, "2020-09-13")])
def test_times(spark, ms, want):
    assert values(spark, [(ms,)], "ms long", text.format_time(F.col("ms"), F.lit(1_704_204_000_000))) == [(want,)]


def test_small_functions(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert [r[0] for r in values(spark, [("30",), ("Mon, 01 Jan 2024 00:01:00 GMT",), ("soon",)], "h string", text.retry_after_seconds(F.col("h"), now))] == [30, 60, None]
    assert values(spark, [(["a😀", "é"],)], "p array<string>", text.count_chars(F.col("p")), text.utf8_size(F.col("p"))) == [(4, 7)]
    assert values(spark, [("一 二三四五",)], "t string", text.cover_text(F.col("t"))) == [("一二三四",)]
    assert values(spark, [("7", 1), ("7", 3)], "b string, p int", urls.toc_url("http://x", F.col("b"), F.col("p"))) == [("http://x/book/7/",), ("http://x/book/7/2.html",)]
    assert values(spark, [(bytearray("中".encode("gb18030")),)], "b binary", codecs.decode_file(F.col("b"))) == [("中",)]
    page = parse.PageRules(noise=("^x$",))
    assert values(spark, [("x",), ("上一章",)], "t string", parse.is_noise(F.col("t"), page)) == [(True,), (False,)]


def test_upper_medians(spark):
    rows = spark.createDataFrame([("a", n) for n in (5, 1, 9, 3)] + [("b", 7), ("b", 7), ("b", 1), ("c", None)], "k string, n int")
    assert sorted(map(tuple, toc.upper_medians(rows, ["k"], "n").collect())) == [("a", 5), ("b", 7)]


def test_written_books(spark, tmp_path):
    rows = spark.createDataFrame([("b", k, f"chapter {k}\n") for k in range(30)], "book_id string, order_key int, value string")
    archives.write_books(rows, f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out/book_id=b").collect() if r.value] == [f"chapter {k}" for k in range(30)]


def test_streams(spark, tmp_path):
    at = [(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02"), (2, "2024-01-01 00:00:30"), (3, "2024-01-01 01:00:00")]
    spark.createDataFrame(at, "k int, t string").selectExpr("k", "timestamp(t) AS t").write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("k int, t timestamp").parquet(f"{tmp_path}/in")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r.k for r in run(flows.first_in_flight(read(), "k", "t", "10 minutes"), "first")) == [1, 2, 3]
    assert sum(r.n for r in run(flows.windowed_counts(read(), "t", "1 minute", "1 minute", []), "counted")) >= 3
    assert [r.k for r in run(flows.debounced_stream(read(), ["k"], "t", "5 seconds", "1 minute"), "calm") if r.k == 1] == [1]


def test_chapter_pages_follow_links(spark):
    page = lambda at, ps, same=(), nxt=None: ("b", "1", at, "ok", "t", ps, None, nxt, list(same), None, False)
    kind = "book_id string, chapter_id string, page_index int, outcome string, title string, paragraphs array<string>, prev_id string, next_id string, same_pages array<int>, declared_page int, restricted boolean"
    got = chapters.assemble(spark.createDataFrame([page(0, ["a"], [1, 2]), page(1, ["b"]), page(2, ["a"]), page(5, ["z"])], kind)).first()
    assert (got.paragraphs, got.complete, got.missing) == (["a", "b"], True, [])


def test_modes_and_ordered_reads(spark):
    whole = families.Family("whole", "w-", ("w.example.com",), (), (), "", "", mode="download")
    got = values(spark, [("north-1",), ("w-2",), ("local-a1",), ("5",), (None,)], "b string", *[families.is_mode(F.col("b"), [SITE, whole], m) for m in ("online", "download")], families.is_stored_book(F.col("b"), [SITE, whole]))
    assert got == [(True, False, False), (False, True, True), (False, False, True), (False, False, False), (False, False, False)]
    rows = spark.createDataFrame([("b", 1, None), ("a", 1, 5), ("a", 2, 9), ("a", 0, 9)], "k string, n int, t int")
    assert [tuple(r) for r in stores.in_order(rows, ["k"], ["-t", "n"]).collect()] == [("a", 0, 9), ("a", 2, 9), ("a", 1, 5), ("b", 1, None)]


def test_cache_reads(spark):
    cache = spark.createDataFrame([("a", 10, "old"), ("a", 90, "new"), ("b", 49, "gone"), ("c", 50, "just")], "key string, expires long, body string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "key string")
    assert {r.key: (r.hit, r.body) for r in stores.cache_read(asked, cache, F.lit(50)).collect()} == {"a": (True, "new"), "b": (False, None), "c": (True, "just"), "d": (False, None), None: (False, None)}
    kept = stores.with_max_age(spark.createDataFrame([("a", 1000, 2), ("b", 1000, 0), ("c", 1000, None)], "key string, at long, age int"), "at", F.col("age"))
    assert [(r.key, r.expires) for r in kept.collect()] == [("a", 3000)]
    assert stores.oldest(cache, ["key"], "expires").filter("key = 'a'").first().body == "old"


def test_exports_can_be_cleaned(spark):
    toc_ = spark.createDataFrame([("b", 1, "1")], "book_id string, order_key int, chapter_id string")
    stored = spark.createDataFrame([("b", "1", "t", ["一句，", "本章未完，请点击下一页继续阅读", "接着。", "（本章完）"])], "book_id string, chapter_id string, title string, paragraphs array<string>")
    assert archives.export_text(toc_, stored).first().value.count("\n") == 6
    assert archives.export_text(toc_, stored, cleaned=True).first().value == "t\n\n一句，接着。\n"


def test_other_source_pages(spark):
    got = values(spark, [("第50章 x", 600, 12), ("第5000章", 600, 12), ("第650章", 600, 12), ("终章", 600, 12), ("第9章", 60, 6), ("第700节", 0, 9)], "t string, n int, p int", search.other_page_window(F.col("t"), F.col("n"), F.col("p")))
    assert [g[0] and tuple(g[0]) for g in got] == [(7, 12), None, (7, 12), None, None, None]


def test_blocks_of_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(segment, "SLICE", 2)
    docs = spark.createDataFrame([(k, None if k == 3 else ["x" * k, "", "y" * 7]) for k in range(6)], "doc_id long, paragraphs array<string>").coalesce(1)
    df = segment.build_blocks(docs, size=6)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    got = sorted((r[0], r[1], r[2], r[3], r[4], list(r[5])) for r in df.collect())
    assert got == [(k, i, *b) for k in range(6) if k != 3 for i, b in enumerate(segment.blocks_of(["x" * k, "", "y" * 7], 6))]
