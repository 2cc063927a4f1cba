"""Literal cases of cleaning, and its agreement in both forms."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import clean

CASES = [
    (["他说，", "本章未完，请点击下一页继续阅读！", "然后走了。"], ["他说，然后走了。"]),
    (["他走了", "本小章还未完，请点击下一页", "很显然。"], ["他走了", "很显然。"]),
    (["a", "（本章完）", "", "  ", "b"], ["a", "b"]),
    (["最新章节请看"], [clean.EMPTY_NOTE]),
    ([" ", ""], []),
    (["text www.example.com more"], ["text more"]),
    (["x &amp; y &lt;b", "p<br/>q"], ["x & y <b", "pq"]),
    (["请点击下一页", "start，", "无弹窗阅读", "end"], ["start，", "end"]),
    (["open，", "请翻页", "无弹窗阅读", "end"], ["open，end"]),
    (["　　第一句， ", "-->>本章未完，点击下一页继续阅读", "　　第二句。"], ["第一句，第二句。"]),
    (["长" * 90 + "最新章节"], ["长" * 90 + "最新章节"]),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(k, list(p)) for k, (p, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id int, paragraphs array<string>")


def test_fold(cleaned):
    got = {r.doc_id: r.p for r in cleaned.select("doc_id", clean.clean_array(F.col("paragraphs")).alias("p")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_islands_agree_with_the_fold(cleaned):
    lines = cleaned.select("doc_id", F.posexplode("paragraphs").alias("pos", "text"))
    got = {}
    for r in sorted(clean.clean_paragraphs(lines, ["doc_id"]).collect(), key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {k: want for k, (_, want) in enumerate(CASES) if want}


def test_idempotent(cleaned, spark):
    once = cleaned.select("doc_id", clean.clean_array(F.col("paragraphs")).alias("p"))
    twice = once.select("p", clean.clean_array(F.col("p")).alias("q"))
    assert all(r.p == r.q for r in twice.collect())
