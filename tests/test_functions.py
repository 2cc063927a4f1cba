"""Literal cases of the scalar functions."""

from pyspark.sql import functions as F

from folioforge.functions import dialect, markup, text, titles, urls
from folioforge.sources.codecs import file_text, gbk_component, page_text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def each(spark, values, column, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}").select("k", column.alias("y")).collect()
    return [r.y for r in sorted(rows)] if kind != "string" else [r.y for r in sorted(rows, key=lambda r: r.k)]


def test_numbers(spark):
    want = {"一": 1, "十": 10, "十一": 11, "二十": 20, "一百零一": 101, "两千七百七十一": 2771, "四千三百二十五": 4325, "三万二": 30002, "12": 12, "": None, "x": None, "一x": None}
    assert each(spark, list(want), titles.chinese_number(F.col("x"))) == list(want.values())


def test_titles(spark):
    want = {
        "分节阅读第2771节": ("第2771章", 2771, False),
        "803 第803章 真的": ("第803章 真的", 803, False),
        "第二千章　 题": ("第二千章 题", 2000, False),
        "番外第十八章 某": ("番外第十八章 某", 18, True),
        "完本感言": ("完本感言", None, False),
        "第十二 题目": ("第十二 题目", 12, False),
    }
    got = each(spark, list(want), titles.normal_title(F.col("x")))
    assert [tuple(r) for r in got] == list(want.values())
    assert one(spark, "第12章  某题", titles.rest_title(F.col("x"), F.col("x"))) == "某题"


def test_text(spark):
    assert one(spark, "a&amp;lt;&#x41;&#66;&nope;&nbsp;b", text.decode_entities(F.col("x"))) == "a&lt;AB&nope; b"
    assert one(spark, "<p> a　 b </p>\r\n<i>c</i><br>d<p>", text.clean_text(F.col("x"))) == "a b\nc\nd"
    assert one(spark, "5L2g 5aW9\n", text.from_base64(F.col("x"))) == "你好"
    assert one(spark, "a😀", dialect.utf16_length(F.col("x"))) == 3
    assert one(spark, "﻿ a 　b ", dialect.collapse(F.col("x"))) == "a b"
    assert each(spark, [10, 2048, 3 << 20], text.format_bytes(F.col("x")), "long") == ["10 B", "2.0 KB", "3.0 MB"]
    assert each(spark, [" a  b ", "", "x" * 31, "a\x01"], text.search_query(F.col("x"))) == ["a b", None, None, None]
    assert each(spark, ["abcdef", "ab"], text.excerpt(F.col("x"), 3)) == ["abc…", "ab"]
    assert one(spark, "标题（第2页）", text.title_without_page(F.col("x"))) == "标题"
    assert each(spark, [0, 1, 9], text.backoff_ms(F.col("x")), "int") == [400, 800, 4000]


def test_urls(spark):
    got = each(spark, ["12", "012", "local-a1", "x"], urls.route(F.col("x")))
    assert got == ["main", None, "local", None]
    links = each(spark, ["/book/9/123456.html", "https://a.b/book/9/123456_2.html?q#z", "/book/9/12.html", "/book/8/123456.html"], urls.chapter_link(F.col("x"), F.lit("9")))
    assert [tuple(r) if r else None for r in links] == [("123456", 0), ("123456", 2), None, None]
    allowed = each(spark, ["https://a.b/x", "https://a.b:443/x", "http://u@a.b/x", "https://a.b/../x", "https://c.b/x", "ftp://a.b/x", None], urls.is_allowed(F.col("x"), ["a.b"]))
    assert allowed == [True, True, False, False, False, False, False]
    assert one(spark, "7", urls.chapter_url("https://a.b", F.lit("1"), F.col("x"), F.lit(3))) == "https://a.b/book/1/7_3.html"


def test_markup(spark):
    page = "<title>T</title><div class='a x'>1<div>2</div>3</div><!-- <a href=z>z</a> --><a href='p q'> L <b>k</b></a><a class=c href=r>m</a><select><option value='/book/1/4.html'></select><meta content=\"v\" property=\"og:t\">"
    assert one(spark, page, markup.title(F.col("x"))) == "T"
    assert one(spark, page, markup.div_inner(F.col("x"), "class", "x")) == "1<div>2</div>3"
    assert [tuple(a) for a in one(spark, page, markup.anchors(F.col("x")))] == [("p q", "Lk"), ("r", "m")]
    assert one(spark, page, markup.total_pages(F.col("x"))) == 5
    assert one(spark, page, markup.meta(F.col("x"), "og:t")) == "v"


def test_codecs(spark):
    assert page_text("标题".encode("gbk"), "text/html; charset=GBK") == "标题"
    assert page_text("<meta charset=gb2312>标".encode("gbk"), None).endswith("标")
    assert page_text(b"\xff", "text/html; charset=latin-1") == "�"
    assert file_text("标".encode("gb18030")) == "标" and file_text("a".encode("utf-16")) == "a" and file_text("﻿b".encode()) == "b"
    assert one(spark, "万 a", gbk_component(F.col("x"))) == "%CD%F2%20a"
