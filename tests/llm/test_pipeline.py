"""The corpus pipeline on the smallest tables, stage by stage against brute force."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_minhash import brute
from tests.llm.test_spans import base_pii, hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows that each stage returns, by name, and the documents as ``start``."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, top = {"start": docs.collect()}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out[name] = docs.collect()
    return out


def test_columns_and_registration(steps):
    for name in ("quality", "near_dedup", "decontaminate", "redact"):
        assert [*steps[name][0].asDict()] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_quality_keeps_what_is_labelled_good(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps["quality"]}
    good, bad = [i for i, q in labels.items() if q], [i for i, q in labels.items() if not q]
    assert np.mean([i in kept for i in good]) > 0.95 and np.mean([i in kept for i in bad]) < 0.5


def test_one_of_each_group(steps):
    found = brute([(r.doc_id, r.text) for r in steps["quality"]], 5, 80)
    assert sorted(r.doc_id for r in steps["near_dedup"]) == sorted(i for i, (_, c) in found.items() if i == c)


def test_contaminated_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in steps["decontaminate"]) == sorted(r.doc_id for r in steps["near_dedup"] if not hits(r.text, items)[1])


def test_redaction(steps):
    before = {r.doc_id: r.text for r in steps["decontaminate"]}
    assert before.keys() == {r.doc_id for r in steps["redact"]}
    for r in steps["redact"]:
        if not base_pii(before[r.doc_id]):
            assert r.text == before[r.doc_id] or re.search(r"\[(NAME|SSN|IBAN|LOCAL_PHONE|MASKED_EMAIL)\]", r.text)
        assert not base_pii(r.text) and r.n_chars == len(r.text)


def test_all_tokens_are_packed(steps):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in sorted(steps["pack"], key=lambda r: (r.doc_id, r.start)):
        pieces.setdefault(r.doc_id, []).extend(r.ids)
    assert pieces == {r.doc_id: own.encode(r.text, add_special_tokens=False).ids + [1] for r in steps["redact"]}


def test_repeated_rows_null_texts_and_no_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    some = [(1, "A b c d e f g h", "en", "s", 15), (1, "A b c d e f g h", "en", "s", 15), (2, None, None, None, None), (None, "zz yy", "en", None, 5), (3, "mail a@b.co", "en", "s", 11)]
    docs = spark.createDataFrame(some, kind)
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() == 4
    assert corpus_pipeline.decontaminate(spark, docs, SF).count() == 5
    texts = sorted(str(r.text) for r in corpus_pipeline.redact(spark, docs, SF).collect())
    assert texts == ["A b c d e f g h", "A b c d e f g h", "None", "mail [EMAIL]", "zz yy"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_with_null_and_reused_ids(spark):
    """Each row is judged by its own text: a null id hides nothing, and a clean text stays beside a contaminated one of its id."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    a = " ".join(f"a{k}" for k in range(60))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(None, item), (1, item), (1, "clean words"), (2, a), (None, a + " z"), (3, "b " + a), (3, "other text of three"), (None, None)]], kind)
    left = corpus_pipeline.decontaminate(spark, docs, SF).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(str((r.doc_id, r.text)) for r in docs.collect() if r.text != item)
    left = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str((r.doc_id, (r.text or "")[:6])) for r in left) == sorted(map(str, [(1, item[:6]), (1, "clean "), (2, a[:6]), (3, "other "), (None, "")]))
