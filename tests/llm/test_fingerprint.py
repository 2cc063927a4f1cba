"""Chunks and fingerprints against a chunker that goes byte by byte."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, lang string, fingerprint string, n_chars long, part long, kind string"
WORDS = [f"{a}{b}{c}" for a in "klmnprst" for b in ("a", "eo", "ü", "i") for c in ("n", "rd", "x", "lang")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def chunks(raw):
    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + fp.MOST)
        for p in range(start + fp.LEAST, end + 1):
            h = 0
            for b in raw[max(0, p - fp.REACH) : p]:
                h = ((h << 1) + int(fp._GEAR[b])) % (1 << 32)
            if h < 1 << (32 - (fp.STRICT if p < start + fp.USUAL else fp.LOOSE)):
                end = p
                break
        out.append(raw[start:end])
        start = end
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=400), st.integers(0, 9).map(lambda n: prose(n, 40 * n))), max_size=5))
def test_cuts(texts):
    raw = [t.encode() for t in texts]
    data = b"".join(raw)
    got = [[] for _ in raw]
    for k, a, b in zip(*fp.cuts(raw), strict=True):
        got[k].append(data[a:b])
    assert got == list(map(chunks, raw))


def test_pieces(monkeypatch):
    raw = [prose(n, 300).encode() for n in range(4)]
    whole = fp.chunk_sets(raw)
    monkeypatch.setattr(fp, "PIECE", 100)
    assert fp.chunk_sets(raw) == whole


def held(a, b):
    own = {c: len(c) for c in chunks(a.encode())}
    both = own.keys() & set(chunks(b.encode()))
    return sum(own[c] for c in both) / sum(own.values()) if own else float(not b)


def test_compared_with_brute_force(spark):
    texts = {i: prose(i, (i * 37) % 200) for i in range(60)} | {60: None, 61: "", 62: prose(3, 111), 63: "ж" * 3000, 64: prose(64, 4000)}
    rows = [(i, t, "x", "clash", 1, 2, "tail") for i, t in texts.items()]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.doc_id: r for r in fp.compared(docs).collect()}
    ids = sorted(texts, reverse=True)
    assert set(got) == set(texts) and got[3].n_chars == got[62].n_chars and got[3].fingerprint == got[62].fingerprint
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        own, other, r = texts[i] or "", texts[following] or "", got[i]
        half = len(own) // 2
        new = own[: len(own) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == pytest.approx((held(own, new), held(own, other)))
        assert r.fingerprint == ",".join(fp.chunk_sets([own.encode()])[0]) and r.edited_fingerprint == ",".join(fp.chunk_sets([new.encode()])[0])
    # As columns, from the fingerprints alone.
    share = fp.compared(docs).select(F.max(F.abs(fp.contained(F.col("fingerprint"), F.col("edited_fingerprint")) - F.col("near_edited")))).first()[0]
    assert share < 1e-12


def test_half_of_an_edited_text_is_found(spark):
    docs = spark.createDataFrame([(i, prose(i, 600), "x", None, 1, 2, "") for i in range(40)], SCHEMA)
    for r in fp.compared(docs).collect():
        assert 0.45 < r.near_edited < 0.56 and r.near_next < 0.02


def test_shifts():
    own = prose(1, 800)
    moved = "some words before " + own[:2000] + " and others within " + own[2000:]
    a, b = fp.chunk_sets([own.encode(), moved.encode()])
    assert fp._held(a, b) > 0.9


def test_null_repeated_and_no_rows(spark):
    rows = [(None, "one", None, None, None, None, None), (1, "two words", None, None, None, None, None), (1, "two words", None, None, None, None, None), (1, None, None, None, None, None, None), (None, None, None, None, None, None, None)]
    got = fp.compared(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (1, 0), (1, 9), (1, 9)]
    alone = fp.compared(spark.createDataFrame(rows[1:2], SCHEMA)).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in alone] == [(1, 1.0, hashlib.sha256(b"two wtwo ").hexdigest())]
    none = spark.createDataFrame([], SCHEMA)
    assert fp.compared(none).collect() == [] and fp.fingerprints(none).collect() == []
    plain = fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.n_chars for r in plain) == [0, 0, 3, 9, 9] and len({r.fingerprint for r in plain}) == 3
