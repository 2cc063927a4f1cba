"""Books are imported whole or not at all."""

import io
import zipfile

import pytest

from folioforge.operators.books import TextRules
from folioforge.sources import imports

BOOK = "『一本书/作者:某人』\n第1章 始\n　　甲。\n第2章 中\n　　乙。\n　　丙。\n第3章 末\n　　丁。"


def zipped(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("book.txt", text.encode("gb18030"))
    return out.getvalue()


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_bytes(BOOK.encode())
    (tmp_path / "in" / "two.zip").write_bytes(zipped(BOOK))
    (tmp_path / "in" / "torn.zip").write_bytes(zipped(BOOK)[:50])
    (tmp_path / "in" / "blank.txt").write_bytes(b" \n ")
    return str(tmp_path / "in" / "*"), str(tmp_path / "store")


def chapters(spark, store):
    found = {}
    for r in imports.ready(spark, store, "chapters").orderBy("book_id", "position").collect():
        found.setdefault(r.book_id, []).append((r.chapter_id, r.title, r.paragraphs, r.prev_id, r.next_id, r.char_count, r.bytes))
    return found


def test_each_file_on_its_own(spark, files):
    paths, store = files
    got = {r.book_id: r for r in imports.import_into(spark, paths, store).collect()}
    assert {b: r.status for b, r in got.items()} == {"one": "READY", "two": "READY", "torn": "FAILED", "blank": "FAILED"}
    assert (got["one"].title, got["one"].author, got["one"].chapters) == ("一本书", "某人", 4) and got["blank"].error == imports.NO_CHAPTERS and got["torn"].error
    found = chapters(spark, store)
    assert set(found) == {"one", "two"} and found["one"] == found["two"]
    assert found["one"][2] == ("3", "第2章 中", ["乙。", "丙。"], "2", "4", 4, 12)
    for name in ("entries", "blocks", "pages"):
        assert {r.book_id for r in imports.ready(spark, store, name).select("book_id").collect()} == {"one", "two"}
    assert imports.ready(spark, store, "blocks").filter("book_id = 'one' and chapter_id = '3'").first().text == "乙。\n\n丙。"


def test_a_failed_run_leaves_nothing_and_keeps_the_former(spark, files, monkeypatch, tmp_path):
    paths, store = files
    imports.import_into(spark, paths, store)
    before = chapters(spark, store)
    monkeypatch.setattr(imports, "build_blocks", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("the disk is full")))
    with pytest.raises(RuntimeError, match="the disk is full"):
        imports.import_into(spark, paths, store)
    assert chapters(spark, store) == before
    states = imports.states(spark, store)
    failed = states.filter("status = 'FAILED' and error like '%disk is full%'").collect()
    assert {r.book_id for r in failed} == {"one", "two", "torn", "blank"} and not states.filter("status = 'IMPORTING'").count()
    gone = {r.import_id for r in failed}
    assert not [p for p in (tmp_path / "store").rglob("import_id=*") if p.name.split("=")[1] in gone]


def test_an_import_that_never_ended_is_not_seen(spark, files):
    paths, store = files
    imports.import_into(spark, paths, store)
    before = chapters(spark, store)
    # What a driver that was lost leaves behind: rows and a log row, but no end.
    spark.createDataFrame([("one", "9", 0, "t", ["x"], 1, 1, None, None, "local", True)], imports.TABLES["chapters"]).write.parquet(f"{store}/chapters/import_id=lost")
    spark.createDataFrame([("one", "lost", "IMPORTING", "t", None, None, None, 1, None, 10**15)], imports.LOG).write.mode("append").parquet(f"{store}/imports")
    assert chapters(spark, store) == before
    imports.import_into(spark, paths, store)
    assert chapters(spark, store) == before


def test_by_catalog(spark, files):
    paths, store = files
    entries = [("one", 0, "11", "第1章始"), ("one", 1, "12", "第2章中"), ("one", 2, "13", "第2章半"), ("one", 3, "14", "第3章末"), ("two", 0, "x", "other")]
    catalog = spark.createDataFrame(entries, "book_id string, index int, id string, title string")
    got = {r.book_id: r for r in imports.import_into(spark, paths, store, catalog, rules=TextRules()).collect()}
    assert (got["one"].status, got["one"].chapters, got["one"].missing) == ("READY", 3, 1) and got["two"].missing == 0
    found = chapters(spark, store)
    assert [c[:2] for c in found["one"]] == [("11", "第1章始"), ("12", "第2章中"), ("14", "第3章末")] and found["one"][1][3:5] == ("11", "14")
    assert [c[0] for c in found["two"]] == ["1", "2", "3"]
    assert [(r.book_id, r.id) for r in imports.ready(spark, store, "missing").collect()] == [("one", "13")]
