"""Pages to rows, and personal documents to records and back."""

import base64
from dataclasses import replace

from pyspark.sql import functions as F

from folioforge.functions import families, markup, text, urls
from folioforge.operators import chapters, parse, search, toc
from folioforge.sources import personal


def page(k, lines, next_chapter=None, encode=False):
    body = "".join(f"<p>{x}</p>" for x in lines)
    text = f"<script>document.writeln(q.b('{base64.b64encode(body.encode()).decode()}'))</script>" if encode else f"<div id='content'>{body}</div>"
    tail = f"<a href='/book/9/{next_chapter}.html'>下一章</a>" if next_chapter else "<a href='/book/9/123456_1.html'>下一页</a>"
    return f"<h1>题目（第{k + 1}页）</h1><a href='/book/9/123455.html'>上一章</a>{text}<a href='/book/9/'>x</a>{tail}"


def test_parse_and_assemble(spark):
    rows = [("9", "123456", 0, page(0, ["一", "题目", "加入书架", "二"], encode=True)), ("9", "123456", 1, page(1, ["三&amp;"], "123457"))]
    pages = parse.chapter_pages(spark.createDataFrame(rows, "book_id string, chapter_id string, page_index int, html string"))
    got = {r.page_index: r for r in pages.collect()}
    assert (got[0].title, got[0].paragraphs, got[0].prev_id, got[0].same_pages, got[0].declared_page) == ("题目", ["一", "二"], "123455", [1], 0)
    r = chapters.assemble(pages).first()
    assert (r.paragraphs, r.complete, r.prev_id, r.next_id) == (["一", "二", "三&"], True, "123455", "123457")


def test_lists(spark):
    html = "".join(f"<a href='/book/9/{i}.html'>第{n}章</a>" for i, n in ((100003, 3), (100002, 2), (100003, 3), (100001, 1))) + "<a href='/book/9/2.html'>页</a>"
    found = parse.catalog(spark.createDataFrame([("9", html)], "book_id string, html string"))
    assert [r.id for r in found.orderBy("order_key").collect()] == ["100001", "100002", "100003"]
    hits = "<ul id='novel-search'>" + "".join(f"<li><span class='s2'><a href='/book/{k % 60 + 1}/'>t{k}</a></span></li>" for k in range(80))
    rows = {}
    for r in parse.listed_results(spark.createDataFrame([("a", hits), ("b", "<ul id='novel-search'>"), ("c", "<p>")], "query string, html string"), parse.ROWS).orderBy("query", "rank").collect():
        rows.setdefault(r.query, []).append(r)
    assert (len(rows["a"]), rows["a"][0].title, rows["b"][0].id, rows["b"][0].recognised, rows["c"][0].recognised) == (50, "t0", None, True, False)
    info = parse.book_info(spark.createDataFrame([("9", "<meta property=\"og:title\" content=\"A&amp;B\">")], "book_id string, html string")).first()
    assert info.title == "A&B" and info.author is None


def test_personal_round_trip(spark):
    kind = "user_id string, kind string, book_id string, id string, chapter_id string, updated_at long"
    rows = [("u", "progress", "1", None, "10", 5), ("u", "bookmark", "1", "b", "10", 6), ("u", "history", "2", "h", "11", 7)]
    document = personal.export_json(spark.createDataFrame(rows, kind))
    records, rejected = personal.import_json(document)
    assert sorted(map(tuple, records.collect()), key=str) == sorted(rows, key=str) and rejected.count() == 0
    bad = spark.createDataFrame([("x", "{"), ("y", '{"version":1,"books":{"a b":{"history":[{"chapter_id":"1","updated_at":1}]},"c":{"history":[{"chapter_id":"z","updated_at":1},{"chapter_id":"2","updated_at":-1},{"chapter_id":"3","updated_at":1}]}}}')], "user_id string, document string")
    records, rejected = personal.import_json(bad)
    assert [(r.book_id, r.chapter_id) for r in records.collect()] == [("c", "3")] and rejected.first().user_id == "x"


def test_small_rules(spark):
    rows = spark.createDataFrame([("1", "书名", 1, 2, "12万字"), ("local-1", "x", 3, 9, "?")], "book_id string, title string, a int, b int, said string")
    got = rows.select(urls.is_online(F.col("book_id")), urls.toc_range_is_valid(F.col("a"), F.col("b")), F.round(text.size_estimate_mb(F.col("said")), 3)).collect()
    assert [tuple(r) for r in got] == [(True, True, 0.108), (False, False, None)]
    hits = spark.createDataFrame([("1", 1, "h1", "别的"), ("1", 2, "h2", "书 名"), ("local-1", 1, "h3", "y")], "book_id string, rank int, hit_id string, title string")
    assert sorted(map(tuple, search.alternatives(rows, hits).collect())) == [("1", "h2", True), ("local-1", "h3", False)]
    entries = spark.createDataFrame([("1", "a", "题", 0, False), ("1", "b", "题", 1, True)], "book_id string, chapter_id string, title string, pos int, extra boolean")
    assert search.same_chapter(entries, entries).orderBy("chapter_id").first().other_id == "a"
    assert tuple(toc.shown_counts(entries).first()) == ("1", 2, 1, 1) and toc.shown(entries, "extra").count() == 1
    pages = spark.createDataFrame([("1", 1, "ok", None), ("1", 2, "ok", 5), ("1", 3, "failed", None)], "book_id string, page int, outcome string, total_pages int")
    assert tuple(toc.range_result(pages).first()) == ("1", 5, [1, 2], [3])


def first(spark, html, *columns, kind="html string"):
    return tuple(spark.createDataFrame([(html,)], kind).select(*columns).first())


def test_titles_and_places(spark):
    html = F.col("html")
    said = lambda page: first(spark, page, parse.page_title(html), parse.place_of(html))
    assert said('<h1>Site</h1><h2 class="x chapter-title">第9章 甲（第2页）</h2><title>t</title>') == ("第9章 甲（第2页）", 1)
    assert said("<title>第9章 甲(某人) 第3页</title><h1>Site</h1>") == ("第9章 甲", 2)
    assert said("<h2 class='chapter-title'>x</h2><title>A&amp;B 乙（第4页）</title>") == ("A&B 乙", 3)
    assert said("<script>lastread.set('9','123456','t','u','4','x')</script><title>甲（第2页）</title>") == ("甲", 4)
    assert said("<script>lastread.set('9','1')</script>") == (None, None) and said(None) == (None, None)


def test_links_of_chapters(spark):
    rows = spark.createDataFrame([(u,) for u in ("/book/9_12.html", "/book/9_12.html?x#y", "/book/8_12.html", "/book/9/12_3.html", "/book/9/12.html", "/book/9/1234567.html", " //h/book/9/123456_0.html ")], "u string")
    got = [r[0] and tuple(r[0]) for r in rows.select(urls.chapter_link(F.col("u"), F.lit("9"))).collect()]
    assert got == [("12", 0), ("12", 0), None, ("12", 3), None, ("1234567", 0), ("123456", 0)]


def test_pages_of_contents(spark):
    link = lambda i, t: f'<a class="x" href="/book/9/{i}.html">{t}</a>'
    listed = f"<ul class='menu'>{link(500001, 'menu')}</ul><ul id=a class=\"ph_list\">{link(500002, '第1章&nbsp; 甲')}{link('500003_1', '第2页')}{link(500004, '下一页')}</ul><ul class=\"y section-list\">{link(500005, '第2章')}</ul>"
    plain = link(500001, "一") + link(500002, "") + link(12, "尾页") + link(500003, "首页")
    rows = parse.toc_items(spark.createDataFrame([("9", 1, listed), ("9", 2, plain), ("9", 3, None)], "book_id string, page int, html string"))
    assert [(r.page, r.id, r.title) for r in rows.orderBy("page", "pos").collect()] == [(1, "500002", "第1章 甲"), (1, "500005", "第2章"), (2, "500001", "一")]


def test_numbers_of_pages(spark):
    kind = "html string, b string"
    pages = [("<select><option value='/book/9/'>1</option><option value='/book/9/4.html'><option value=\"/book/8/77.html\"></select>", "9"), ("<select><option value='/book/9/'></select>", "9"), ("<select><option value='/book/8/'></select>", "9"), ('<a href="/book/9/3.html">第201-300章</a><a href="/book/9/6.html">第501-600章</a>', "9"), ("<p>", "9")]
    got = [r[0] for r in spark.createDataFrame(pages, kind).select(markup.total_pages(F.col("html"), F.col("b"))).collect()]
    assert got == [5, 1, None, 4, None]


SOUTH = families.Family("south", "south-", ("s.example.com",), (r"\A/book/([0-9]+)\.htm\z",), (r"\A/txt/([0-9]+)/([0-9]+)(?:\.html)?\z",), "https://s.example.com/book/{book}.htm", "https://s.example.com/txt/{book}/{chapter}")


def test_catalogs_by_number_and_in_place(spark):
    item = lambda n, i, t: f"<li{f' data-num={n}' if n else ''}><a href='/txt/7/{i}'>{t}</a></li>"
    latest = f"<ul>{item(None, 99, 'latest')}</ul>"
    numbered = f"{latest}<div class=x id='catalog'><div>{item(3, 30, '丙')}{item(1, 50, '甲')}{item(2, 20, '乙')}{item(9, 20, 'again')}<li>no link</li></div></div>{latest}"
    falling = f"{latest}<div id=\"catalog\">{item(None, 30, '丙')}{item(2, 20, '乙')}{item(None, 10, '甲')}</div>"
    bare = "<div id='catalog'><a href='/txt/7/1'>a</a><script>'<a href=\"/txt/7/3\">c</a>'</script><a href='/txt/8/2'>b</a></div>"
    got = lambda html, rules: [r.id for r in parse.catalog(spark.createDataFrame([("south-7", html)], "book_id string, html string"), rules, SOUTH).orderBy("order_key").collect()]
    assert got(numbered, parse.NUMBERED) == ["50", "20", "30"] and got(falling, parse.NUMBERED) == ["10", "20", "30"] and got(bare, parse.NUMBERED) == ["1"]
    placed = "<div id='a-list'><a href='/txt/7/9'>x</a><a href='/txt/7/3'>y</a><a href='/txt/7/9'>z</a></div><a href='/txt/7/1'>out</a>"
    assert got(placed, parse.IN_PLACE) == ["9", "3"] and got("<a href='/txt/7/1'>out</a>", parse.IN_PLACE) == [] and got(latest, parse.NUMBERED) == ["99"]


def test_ways_of_scripts(spark):
    script = 'var bookinfo = { chaptername: "甲&amp;乙", preview_page: "/txt/7/4", next_page: "/book/7.htm" }'
    page = f"<script>{script}</script><title>x-y</title><div class='a txtnav'>甲&amp;乙<br>文<br>甲&amp;乙<div class='bottom-ad'>z<div>q</div></div><br>spam site</div><a href='/txt/7/6'>下一章</a><a href='/txt/7/3'>上一章</a>"
    alone = "<div class='txtnav'><h1>T</h1>T<br>T<br>u</div><script>{next_page: ''}</script>"
    docs = spark.createDataFrame([("south-7", "5", page), ("south-7", "8", alone), ("south-7", "9", "<div class='txtnav'>u</div>")], "book_id string, chapter_id string, html string")
    rows = {r.chapter_id: r for r in parse.single_page_chapters(docs, SOUTH, replace(parse.ONE_PAGE, advert="spam site")).collect()}
    assert (rows["5"].title, rows["5"].paragraphs, rows["5"].prev_id, rows["5"].next_id, rows["5"].complete) == ("甲&乙", ["文", "甲&乙"], "4", "6", True)
    assert (rows["8"].paragraphs, rows["8"].complete, rows["9"].complete) == (["u"], True, False)


def test_a_search_that_leads_to_its_hit(spark):
    page = '<meta property="og:title" content="书"><meta property="og:novel:author" content="人">'
    rows = [("one", page, "https://s.example.com/book/12.htm?x"), ("odd", "<p>", "https://s.example.com/book/12.htm"), ("none", "没有找到", "https://s.example.com/search"), ("plain", "<ul class='newbox'><li><h3><a href='/book/7.htm'>t</a></h3></li></ul>", None)]
    got = {r.query: r for r in parse.listed_results(spark.createDataFrame(rows, "query string, html string, final_url string"), replace(parse.CARDS, prefix="south-")).collect()}
    assert (got["one"].id, got["one"].title, got["one"].author, got["one"].recognised) == ("south-12", "书", "人", True)
    assert (got["odd"].id, got["odd"].recognised, got["none"].id, got["none"].recognised, got["plain"].id) == (None, False, None, True, "south-7")


def filters(df):
    """Filters of the optimised plan that search by pattern."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "regexp_extract_all" in x]


def test_catalogs_are_read_once(spark):
    page = '<div id="catalog"><li data-num="2"><a href="/book/9/100002.html">b</a></li><li data-num="1"><a href="/book/9/100001.html">a</a></li></div>'
    df = parse.catalog(spark.createDataFrame([("9", page), ("8", ""), ("7", None)], "book_id string, html string"), parse.NUMBERED)
    assert sorted(map(tuple, df.collect())) == [("9", 0, "100001", "a"), ("9", 1, "100002", "b")]
    assert not filters(df)


def test_text_and_links_are_searched_once(spark):
    assert str(parse.text_paragraphs(F.col("html"))._jc).count("writeln") == 1
    searched = str(markup.anchors(F.col("html"))._jc)
    assert searched.count("regexp_extract_all") == 1
    page = """<a x href=/a>A</a><a href="b"> <b>B</b> </a><A HREF='c'>C</A><!--<a href="d">D</a>-->"""
    got = spark.createDataFrame([(page,)], "html string").select(markup.anchors(F.col("html")).alias("a")).first()["a"]
    assert [tuple(x) for x in got] == [("/a", "A"), ("b", "B"), ("c", "C")]
