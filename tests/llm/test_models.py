"""Learned operators: held-out accuracy, edge cases, and base measures against brute force."""

import re
from collections import Counter

import numpy as np
import public_tokenizers

from folioforge.llm import fertility, langid, mil, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def sentences(rng, syllables, n, words=30):
    return [" ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(words)) for _ in range(n)]


def test_languages(spark):
    rng = np.random.default_rng(1)
    langs = {"xx": ["ba", "du", "gi", "lo"], "yy": ["sta", "ner", "ing", "the"], "zz": ["ça", "é", "ou", "que"]}
    train = [(t, k) for k, s in langs.items() for t in sentences(rng, s, 60)]
    model = langid.fit([t for t, _ in train], [k for _, k in train])
    test = [(t, k) for k, s in langs.items() for t in sentences(rng, s, 20)]
    docs = spark.createDataFrame([(i, t, "no") for i, (t, _) in enumerate(test)] + [(900, None, "x"), (901, "12 !!", "x"), (902, "", "x"), (903, "东西" * 50, "x"), (900, None, "x")], "doc_id long, text string, score string")
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(test) + 5
    got = {r.doc_id: r for r in rows}
    assert np.mean([got[i].lang_pred == k for i, (_, k) in enumerate(test)]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].rejected and not any(got[i].rejected for i in range(len(test)))
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit([], [])).collect()} == {"und"}


def test_toxicity_generalises_to_misspellings(spark):
    rng = np.random.default_rng(2)
    plain, bad = ["ba", "du", "gi", "lo", "me", "ra"], ["horrible", "wretched", "vermin", "nitwit"]
    texts, labels = [], []
    for k, t in enumerate(sentences(rng, plain, 600, 50)):
        w = t.split()
        if k % 3 == 0:
            for at in rng.integers(0, len(w), 3):
                w[at] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, np.array(labels), 1 / 3)
    clean, odd = sentences(rng, plain, 40, 200), [f"{a} such horribble nitwitt people {b}" for a, b in zip(sentences(rng, plain, 40, 60), sentences(rng, plain, 40, 60), strict=True)]
    docs = spark.createDataFrame(list(enumerate([*clean, *odd, None, "", "ba " * 50_000])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([got[k] >= 0.5 for k in range(40, 80)]) > 0.8 and np.mean([got[k] >= 0.5 for k in range(40)]) < 0.1
    assert got[80] == got[81] and all(0 <= s <= 1 for s in got.values())
    assert toxicity.fit(["a"], np.array([0]), 0.1).scale == 0 and toxicity.fit([], np.zeros(0, int), 0.1) is not None


def test_quality(spark):
    rng = np.random.default_rng(3)
    good = sentences(rng, ["ba", "du", "gi", "lo"], 200, 150)
    bad = [" ".join(w + "###" for w in t.split()) if k % 2 else t[: len(t) // 2] + " X!! Y!!" * 100 for k, t in enumerate(sentences(rng, ["ba", "du", "gi", "lo"], 200, 150))]
    texts, labels = [*good[:150], *bad[:150]], np.array([1] * 150 + [0] * 150)
    model = mil.fit(texts, labels)
    docs = spark.createDataFrame(list(enumerate([*good[150:], *bad[150:], None, "", "long " * 100_000])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in mil.score(docs, model).collect()}
    assert np.mean([got[k] >= 0.3 for k in range(50)]) > 0.95 and np.mean([got[k] >= 0.3 for k in range(50, 100)]) < 0.05
    assert got[100] == got[101] and all(0 <= s <= 1 for s in got.values())
    assert mil.score(docs.limit(0), model).count() == 0


def test_attention_gradients_are_right():
    rng = np.random.default_rng(4)
    seen = {}
    old, mil.adam = mil.adam, lambda p, g, steps, rate: seen.update(p=p, g=g)
    try:
        mil.fit(["a b c " * 40, "D! " * 90, "e f"], np.array([1, 0, 1]))
    finally:
        mil.adam = old
    p, found = seen["p"], seen["g"](1)
    bags = [mil.features(t) for t in ("a b c " * 40, "D! " * 90, "e f")]
    owner = np.repeat(np.arange(3), [len(b) for b in bags])
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    x = np.concatenate(bags).astype(float)
    p = p | {"mean": x.mean(axis=0), "spread": x.std(axis=0) + 0.02}
    y, w = np.array([1, 0, 1]), np.array([0.25, 0.5, 0.25])

    def loss():
        z = mil.forward(p, x, first, owner)["logit"]
        return (w * (np.log1p(np.exp(z)) - y * z)).sum() + 5e-4 * sum((p[k] ** 2).sum() for k in ("encode", "value", "gate", "weigh", "out"))

    for k in ("encode", "value", "gate", "weigh", "out", "out_bias"):
        at = tuple(rng.integers(0, n) for n in p[k].shape)
        keep = p[k][at]
        p[k][at] = keep + 1e-5
        up = loss()
        p[k][at] = keep - 1e-5
        down = loss()
        p[k][at] = keep
        assert abs((up - down) / 2e-5 - found[k][at]) < 1e-5, k


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_fertility(spark):
    rng = np.random.default_rng(6)
    texts = sentences(rng, ["the ", "house ", "water", "ing "], 80, 80)
    texts += ["\n".join(rng.choice(["a b", "c", "", " ", "d\x0be"], 30)) for _ in range(40)]
    texts += [None, "", "é😀 " * 30, "word " * 30_000, "ԹԺԻ " * 100, " | # <a> & $   x y"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*texts, texts[0]])], "doc_id long, text string, kept int")
    rows = fertility.judged(docs, *PIECES).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = base((texts + [texts[0]])[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    got = {r.doc_id: r for r in rows}
    assert all(got[k].kept for k in range(80))
    assert got[len(texts) - 2].byte_share > 0.5
    assert fertility.judged(docs.limit(0), *PIECES).count() == 0


def test_fertility_rejects_junk_that_sets_its_own_band(spark):
    """A lone very long junk text, short junk, and a source of junk with a third of the rows."""
    rng = np.random.default_rng(8)

    def digits(words):
        return " ".join("".join(rng.choice(list("0123456789"), 5)) for _ in range(words))

    clean = sentences(rng, ["the ", "house ", "water", "ing ", "stone", "er "], 120, 80)
    junk = [digits(80) for _ in range(60)] + [digits(40_000)] + [" ".join(rng.choice(list("0123456789"), 20))]
    rows = fertility.judged(spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string"), *PIECES).collect()
    got = {r.doc_id: r for r in rows}
    assert all(got[k].kept for k in range(120))
    assert not any(got[k].base_failed for k in range(120, 181)) and all(got[k].outside for k in range(120, 181))
    assert got[181].n_tokens < fertility.LEAST_TOKENS and not got[181].base_failed and got[181].outside


def test_scripts():
    said = {"latin": "Hello é", "cyrillic": "Привет", "greek": "Καλημέρα", "cjk": "中文字符", "arabic": "مرحبا", "hangul": "안녕하세요", "hebrew": "שלום"}
    assert {k: fertility.script(v.encode()) for k, v in said.items()} == {k: k for k in said}


def test_class_sample_starts_no_python_rows(spark, monkeypatch):
    """What a sample sends to the executors is an Arrow table: lists of rows start a second daemon of Python workers there."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from folioforge.llm.common import class_sample

    for kind, keys in (("string", ("a", "b")), ("int", (0, 1)), ("long", (0, 1))):
        docs = spark.createDataFrame([(k, keys[k % 2], "x" * (k % 9 + 1)) for k in range(40)], f"doc_id long, key {kind}, text string")
        made, plain = [], type(spark).createDataFrame
        with monkeypatch.context() as m:
            m.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(data) or plain(self, data, *a, **b))
            found = class_sample(docs.select("doc_id", "key", F.length("text").alias("n")), docs, 5, 9)
        assert made and all(isinstance(x, pa.Table) for x in made)
        assert sorted(r["key"] for r in found) == sorted(keys * 5)


def test_class_sample(spark):
    """Bounded, the same each time, whole texts within the bound, and no class is lost because its texts are long."""
    from pyspark.sql import functions as F

    from folioforge.llm.common import LONG_ROWS, class_sample

    rows = [(k, "a" if k % 3 else "b", "x" * (k % 50 + 1)) for k in range(3000)] + [(5000 + k, "c", "y" * (200 + k)) for k in range(60)] + [(1, "a", "w"), (None, "a", "z"), (9001, None, "z"), (9002, "d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, key string, text string").repartition(7)
    found = class_sample(docs.select("doc_id", "key", F.length("text").alias("n")), docs, 100, 40)
    again = class_sample(docs.repartition(3).select("doc_id", "key", F.length("text").alias("n")), docs, 100, 40)
    assert found == again
    kinds = Counter(r["key"] for r in found)
    assert kinds["a"] == kinds["b"] == 100 and kinds["c"] == LONG_ROWS and set(kinds) == {"a", "b", "c"}
    assert all(len(r.text) <= 40 for r in found if r["key"] != "c") and max(len(r.text) for r in found if r["key"] == "c") == 200 + LONG_ROWS - 1
