"""Whole books: catalogs that fit, that don't, and none."""

import random

from pyspark.sql import functions as F

from folioforge.operators import books

TEXTS = "book_id string, text string"
CATALOG = "book_id string, index int, id string, title string"
RULES = books.TextRules(advert="spamsite")
TEXT = "\r\n".join([
    "『一本书/作者:某人』", "front matter", "------章节内容开始-------", "第1章 始", "　　早晨。", "", "　　“去？”", "第2章　续", "\t第三章 是引用", "本章由spamsite提供", "　　spamsite 首发", "第3章 战", "　　同。", "　　同。",
    "第5章 计", "　　（缺第4章。）", "没有缩进但不是标题的一行。", "　　笑。", "=已完结=", "『完』",
])
ENTRIES = [("a", 0, "1", "第1章 始"), ("a", 1, "2", "第2章 续"), ("a", 2, "3", "第3章 战"), ("a", 3, "4", "第4章 空"), ("a", 4, "5", "第5章 计"), ("a", 5, "6", "第6章 末")]


def run(spark, texts, entries, rules=RULES):
    chapters, found, missing = books.whole_books(spark.createDataFrame(texts, TEXTS), spark.createDataFrame(entries, CATALOG), rules)
    by = {}
    for r in chapters.orderBy("book_id", "chapter").collect():
        by.setdefault(r.book_id, []).append((r.chapter_id, r.title, r.paragraphs))
    return by, {r.book_id: r for r in found.collect()}, sorted((r.book_id, r["index"], r.id) for r in missing.collect())


def test_by_catalog(spark):
    chapters, found, missing = run(spark, [("a", TEXT)], ENTRIES)
    assert [c[:2] for c in chapters["a"]] == [("1", "第1章 始"), ("2", "第2章 续"), ("3", "第3章 战"), ("5", "第5章 计")]
    assert [c[2] for c in chapters["a"]] == [["早晨。", "“去？”"], ["第三章 是引用"], ["同。", "同。"], ["（缺第4章。）", "没有缩进但不是标题的一行。", "笑。"]]
    assert missing == [("a", 3, "4"), ("a", 5, "6")]
    assert (found["a"].matched, found["a"].headings, found["a"].aligned, found["a"].chapters) == (4, 5, True, 4)


def test_by_margin(spark):
    other = "------章节内容开始-------\n第1章开\n　　第三章，引用\n第2章坐。\n　　正文。\n番外故事，相当于前传，讲述一些故事，当然，还有别的人物登场，也许还有更多的人要来到这里来看看他们的。"
    chapters, found, missing = run(spark, [("a", TEXT), ("b", other), ("c", "　　只有正文"), ("d", None), ("e", ""), ("f", "只有标题"), ("g", "　　前\n题\n文。")], [("b", 0, "1", "别的"), ("g", 0, "x", None)])
    assert [c[:2] for c in chapters["a"]] == [("1", "第1章 始"), ("2", "第2章　续"), ("3", "第3章 战"), ("4", "第5章 计")]
    assert "没有缩进但不是标题的一行。" in chapters["a"][3][2]
    assert chapters["b"] == [("1", "第1章开", ["第三章，引用"]), ("2", "第2章坐。", ["正文。", other.split("\n")[-1]])]
    assert chapters["c"] == [("1", "正文", ["只有正文"])] and chapters["f"] == [("1", "只有标题", [])] and chapters["g"] == [("1", "正文", ["前"]), ("2", "题", ["文。"])]
    assert not {"d", "e"} & set(chapters) and missing == [] and not any(r.aligned for r in found.values()) and set(found) == set("abcdefg")


def brute(lines, titles, window):
    """(places that matched, index) of lines at the margin, one by one."""
    at, out = 0, []
    for k, line in enumerate(lines):
        j = next((j for j in range(at, min(len(titles), at + window + 1)) if titles[j] == line), None)
        if j is not None:
            out.append((k, j))
            at = j + 1
    return out


def test_order_like_brute_force(spark):
    r = random.Random(4)
    texts, entries, want = [], [], {}
    for b in range(30):
        titles = [f"T{r.randrange(12)}" for _ in range(r.randrange(40))]
        said = [r.choice(titles) if titles and r.random() < 0.8 else "x" for _ in range(r.randrange(40))]
        texts.append((str(b), "\n".join(said)))
        entries += [(str(b), k, f"id{k}", t) for k, t in enumerate(titles)]
        want[str(b)] = (brute(said, titles, 3), len(titles))
    _, found, missing = run(spark, texts, entries, books.TextRules(window=3))
    for b, (matches, n) in want.items():
        assert found[b].matched == len(matches)
        gone = {i for k, i, _ in missing if k == b}
        assert gone == (set(range(n)) - {j for _, j in matches} if found[b].aligned else set())
    assert {r.aligned for r in found.values()} == {True, False}


def test_no_rows_and_extra_columns(spark):
    none = spark.createDataFrame([], TEXTS), spark.createDataFrame([], CATALOG)
    assert [f.collect() for f in books.whole_books(*none)] == [[], [], []]
    texts = spark.createDataFrame([(None, TEXT), ("a", TEXT)], TEXTS).withColumn("index", F.lit(1)).withColumn("lines", F.lit("x"))
    chapters, found, _ = books.whole_books(texts, spark.createDataFrame([*ENTRIES, (None, 0, "1", "第1章 始")], CATALOG).withColumn("text", F.lit("y")), RULES)
    assert chapters.count() == 4 and [r.book_id for r in found.collect()] == ["a"]


def test_lines_are_read_once(spark):
    texts = spark.createDataFrame([(1, "a\n　b"), (2, None), (3, "")], "book_id long, text string")
    chapters, found, missing = books.whole_books(texts, spark.createDataFrame([(1, 0, "7", "a")], "book_id long, index int, id string, title string"))
    assert [tuple(r) for r in chapters.collect()] == [(1, 1, "7", "a", ["b"])]
    for df in (chapters, found, missing):
        plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert not [x for x in plan if "Filter" in x and "split(" in x]
