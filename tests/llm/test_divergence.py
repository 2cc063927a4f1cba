"""Source divergence: hand-made groups against plain counting."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioforge.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, a string, value long, m long"


def brute(rows, least, top=50):
    """Every term of every pair, one by one."""
    counts, docs, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]
        counts[lang, source].update(found)
        total[lang].update(found)
        docs[lang].update(set(found))
    out = set()
    for (lang, source), own in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p(c, kept=kept):
            n = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // n for t in kept}

        mine, q = p(own), p(total[lang])
        far = [(-sum(abs(mine[t] - x) for t, x in p(c).items()), s.encode()) for (g, s), c in counts.items() if g == lang and s != source]
        terms = [(q[t] - mine[t], t.encode()) for t in kept if own[t] and mine[t] > q[t]]
        for part, found in (("pair", sorted(far)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


ROWS = [
    (1, "Alpha beta-beta gamma ÄÖ", "en", "x", "o", 1, 2),
    (1, "Alpha beta-beta gamma ÄÖ", "en", "x", "o", 1, 2),
    (2, "alpha ALPHA delta4delta zeta", "en", "y", None, None, None),
    (3, "beta äö äö gamma zeta " * 40, "en", "z", "o", 1, 2),
    (4, None, "en", "empty", "o", 1, 2),
    (None, "delta alpha", None, None, "o", 1, 2),
    (6, "delta beta alpha", "", "", "o", 1, 2),
    (7, "nothing twice", "xx", "one", "o", 1, 2),
    (8, "", "xx", "two", "o", 1, 2),
    (9, "epsilon " * 3000, "en", "hot", "o", 1, 2),
    (10, "epsilon beta", "en", "ähnlich", "o", 1, 2),
]


@pytest.mark.parametrize("least", [1, 2, 30])
def test_same_as_counting(spark, least):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = divergence.audit(docs, least_docs=least, top=3)
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(ROWS, least, 3))


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_sources_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 50)
    monkeypatch.setattr(divergence, "HELD", 20)
    rows = [(i, " ".join(f"w{chr(97 + (i * k) % 11)}" for k in range(i % 13)), "en", f"s{i % 17}", "o", 1, 2) for i in range(300)]
    batches = list(divergence._joint(iter(kept_batches(rows))))
    assert all(b.num_rows for b in batches)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=5)
    assert set(map(tuple, got.collect())) == brute(rows, 5)


def kept_batches(rows):
    import pyarrow as pa

    by = defaultdict(Counter)
    for r in rows:
        for t in r[1].split():
            by[t][r[3]] += 1
    parts = [[{"source": s, "n": n} for s, n in sorted(c.items())] for c in by.values()]
    kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    return [pa.RecordBatch.from_arrays([pa.array(["en"] * len(parts)), pa.array(parts, kind)], ["lang", "parts"])]


def test_shares_are_exact(spark):
    big = 10**16
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(3 * big), F.lit(7))).first()
    assert row[0] == 1 + 10**9 * (big + 5) // (3 * big + 35)
