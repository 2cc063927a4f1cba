"""Records of wrong kinds, out of range, cut short or not JSON at all; how deep JSON nests."""

import json

import pytest

from pyspark.sql import functions as F

from folioforge.sources import repair


def fixed(spark, texts, fields):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, j string").select("k", repair.repaired(F.col("j"), fields).alias("r")).collect()
    return [r.r and r.r.asDict() for r in sorted(rows)]


def test_settings(spark):
    texts = [json.dumps(x) for x in ({"fontSize": 99, "lineHeight": 0.5, "margin": 20.5, "prefetch": False, "theme": "neon"}, {"fontSize": "20", "prefetch": "false", "paraGap": 1.25, "theme": "dark"}, [], 5)] + ["not json", None, '{"fontSize": 1e999, "maxWidth": -1e308}']
    got = fixed(spark, texts, repair.SETTINGS)
    usual = {f.name: f.default for f in repair.SETTINGS}
    assert got[0] == usual | {"fontSize": 28, "lineHeight": 1.3, "margin": 21, "prefetch": False}
    assert got[1] == usual | {"paraGap": 1.25, "theme": "dark"}
    assert got[2:6] == [usual] * 4
    assert got[6]["maxWidth"] == 24


def test_books_and_places(spark):
    books = [{"id": "12", "title": "t" * 200, "author": 5, "intro": "", "firstChapterId": "12a"}, {"id": "0", "title": "x"}, {"id": "12", "title": ""}, {"id": 12, "title": "x"}, {"id": "abc-7", "title": "y", "intro": "i" * 2000, "firstChapterId": "9"}]
    got = fixed(spark, [json.dumps(b) for b in books] + ["[]", None], repair.BOOK)
    assert got[0] == {"id": "12", "title": "t" * 100, "author": "", "category": None, "status": None, "intro": None, "latestChapter": None, "firstChapterId": None}
    assert got[1:4] == [None] * 3 and len(got[4]["intro"]) == 1000 and got[4]["firstChapterId"] == "9" and got[5:] == [None, None]
    marks = fixed(spark, ['{"chapterId": "7", "paragraph": 3, "offset": 4, "createdAt": 5}', '{"chapterId": "7", "id": "b", "paragraph": "x"}', '{"paragraph": 3}'], repair.BOOKMARK)
    assert marks[0]["id"] == "7-3-4-5" and (marks[1]["id"], marks[1]["paragraph"]) == ("b", 0.0) and marks[2] is None
    assert fixed(spark, ['{"chapterId": "1", "paragraph": -3, "offset": 2.5}'], repair.PROGRESS) == [{"chapterId": "1", "chapterIndex": None, "paragraph": 0.0, "offset": 2.5, "updatedAt": 0.0}]


@pytest.mark.parametrize(("text", "want"), [("[" * 32 + "]" * 32, 32), ("[" * 33 + "]" * 33, 33), ('{"a": "[[[{", "b": [1]}', 2), ('{"a\\"[": "\\\\", "c": {"d": []}}', 3), ("", 0), ("1", 0), (None, None), ("]]][", 0), ('["[[[', 1), ("[[],[[]]]" * 400, 3)])
def test_depth(spark, text, want):
    assert spark.createDataFrame([(text,)], "j string").select(repair.depth(F.col("j"))).first()[0] == want


def test_fields_are_read_once(spark):
    number = str(repair._present(F.col("v"), repair.Field("size", "long", 18, least=14, most=28))._jc)
    assert number.count("schema_of_variant") == 1
