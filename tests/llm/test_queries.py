"""The registered queries on the smallest tables: contracts, brute force, SQL, held-out accuracy."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioforge.llm import queries
from tests.llm.test_fingerprint import held
from tests.llm.test_models import base
from tests.llm.test_spans import base_pii, base_secrets

SF = "/root/testdata/sf0.001"
Q = queries.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, texts):
    got = Q[name](spark, SF).toPandas()
    assert set(got.doc_id) == set(texts)
    return got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = Q[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize(("name", "brute", "kinds"), [("op2_weak_supervision_pii", base_pii, ["email", "ip", "card", "phone"]), ("op3_secret_ledger", base_secrets, ["assign", "access", "hex"])])
def test_spans(spark, texts, name, brute, kinds):
    for r in rows(spark, name, texts).itertuples():
        want = brute(texts[r.doc_id])
        said = [f"{k}:{a}:{b}" for a, _, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | {""}
        assert [getattr(r, f"n_{k}") for k in kinds] == [sum(x[2] == k for x in want) for k in kinds]


def test_token_store(spark, texts):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in rows(spark, "op6_token_store", texts).sort_values("doc_id").itertuples():
        ids = np.array(own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(spark, texts):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op9_vector_packing", texts)
    for i, pieces in got.groupby("doc_id"):
        ids = np.array(own.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in pieces.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() in [1 << k for k in range(12)]


def test_fertility(spark, texts):
    for r in rows(spark, "op7_tokeniser_fertility", texts).itertuples():
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_learned(spark, texts):
    got = rows(spark, "op5_nearest_centroid_language", texts)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = got[got.held_out]
    assert [bool(h) for h in got.held_out] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held.itertuples()]) > 0.95
    for name, cut in (("op8_subword_toxicity", 0.5), ("op10_attention_quality", 0.3)):
        got = rows(spark, name, texts)
        assert [bool(h) for h in got.held_out] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
        assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()


def test_fingerprints(spark, texts):
    got = rows(spark, "op12_chunk_fingerprints", texts)
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    own = dict(zip(got.doc_id, got.fingerprint, strict=True))
    for r in got.itertuples():
        text, other = texts[r.doc_id] or "", texts[after[r.doc_id]] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == pytest.approx(held(text, new)) and r.near_next == pytest.approx(held(text, other))
        assert (r.fingerprint == own[after[r.doc_id]]) == (text == other)


@pytest.mark.parametrize(("name", "label", "found", "false"), [("op8_subword_toxicity", "toxic", 0.55, 0.03), ("op10_attention_quality", "quality", 0.99, 0.05)])
def test_held_out_rows(spark, name, label, found, false):
    """Shares of rows with label 1 that are predicted, and of rows with label 0, among those that were not learned from."""
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.predicted, known[r.doc_id]) for r in Q[name](spark, sf).filter("held_out").collect() if known.get(r.doc_id) is not None]
    assert np.mean([p for p, y in got if y == 1]) > found and np.mean([p for p, y in got if y == 0]) < false
