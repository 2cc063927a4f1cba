import gc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioforge.llm import tokenstore
from folioforge.llm.common import new_folder
from folioforge.llm.encode import UnitEncoder, encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts, end_id=2):
    own = Tokenizer.from_file(PATH)
    return [np.array(own.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4") for t in texts]


@pytest.mark.parametrize(("file", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_give_the_ids_of_whole_texts(file, keeps):
    own = UnitEncoder(public_tokenizers.path(file), keeps, limit=200)
    rng = np.random.default_rng(3)
    parts = ["a", "B", "'s", "'T", " ", "  ", "\n", "\n\n", ".", ",", "!", "12", "é", "é", "ß", "İ", "ΑΣ", "😀", " ", "\t", "\x01", "\x7f", "|", "_", "中文", "don't", "ﬁ", "-", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(1500)]
    for k in range(0, len(texts), 100):
        ids, counts = own.encode(texts[k : k + 100])
        whole = [e.ids for e in own.tokenizer.encode_batch_fast(texts[k : k + 100], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == whole


@pytest.mark.parametrize(("file", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_as_the_library_encodes_them(file, keeps):
    """Against a fresh tokenizer with the library's defaults."""
    own, fresh = UnitEncoder(public_tokenizers.path(file), keeps, limit=200), Tokenizer.from_file(public_tokenizers.path(file))
    rng = np.random.default_rng(7)
    parts = ["a", " ", "\n", "\n\n", ".", "<|", "|>", "é", "see", " here", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\x01"]
    texts = ["see <|endoftext|> here", *("".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(600))]
    ids, counts = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark):
    texts = [None, "", "Hello, world", "line\nline " * 4000, "déjà vu", "Hello, world", "tail"] + [f"Some words here {k} and there {k * k}" for k in range(700)]
    docs = spark.createDataFrame([(k * 3, t, "z") for k, t in reversed(list(enumerate(texts)))], "doc_id long, text string, shard string").repartition(5)
    store = new_folder(spark, "round-trip")
    tokenstore.write(docs, store, PATH, False, 2)
    rows = {r.doc_id: r for r in tokenstore.read_digests(spark, store).collect()}
    before = 0
    for k, ids in enumerate(expected(texts)):
        r = rows[3 * k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    got = {r.doc_id: r.ids for r in tokenstore.fetch(spark, store, [0, 9, 12]).collect()}
    assert {k: v for k, v in got.items()} == {3 * k: expected(texts)[k].tolist() for k in (0, 3, 4)}
    index = tokenstore.index(spark, store).toPandas()
    assert sorted(index.doc_id) == [3 * k for k in range(len(texts))]
    assert spark.read.parquet(f"{store}/dictionary").first().content


def test_repeated_null_and_no_rows(spark):
    store = new_folder(spark, "few")
    tokenstore.write(spark.createDataFrame([(1, "b"), (1, "b"), (None, "c")], "doc_id long, text string"), store, PATH, False, 2)
    rows = sorted((r.start, r.doc_id) for r in tokenstore.read_digests(spark, store).collect())
    assert rows == [(0, None), (2, 1), (4, 1)]
    store = new_folder(spark, "none")
    tokenstore.write(spark.createDataFrame([], "doc_id long, text string"), store, PATH, False, 2)
    assert tokenstore.read_digests(spark, store).count() == 0


@pytest.mark.parametrize(("n", "chars"), [(60, 24_000), (3, 40_000), (900, 300)])
def test_a_dictionary_whatever_the_length(spark, n, chars):
    rng = np.random.default_rng(n)
    words = ["alpha", "beta", "gamma", "delta", "omega", "token", "store", "index", "frame", "block"]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, chars // 6))) for k in range(n)], "doc_id long, text string").repartition(4)
    store = new_folder(spark, "long")
    tokenstore.write(docs, store, PATH, False, 2)
    r = spark.read.parquet(f"{store}/dictionary").first()
    assert len(r.content) >= 1024 and r.samples >= 16
    assert tokenstore.read_digests(spark, store).count() == n


def test_too_little_to_train_on_is_recorded(spark):
    store = new_folder(spark, "little")
    tokenstore.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), store, PATH, False, 2)
    r = spark.read.parquet(f"{store}/dictionary").first()
    assert (bytes(r.content), r.samples) == (b"", 1)


def test_forgotten_words_are_freed_at_once():
    """Without a garbage collection: a packing worker makes too few containers for one to come soon."""
    units = UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"), True, 100)
    gc.collect()
    gc.disable()
    try:
        for k in range(5):
            units.encode([" ".join(f"kept{k}word{j}" for j in range(300))])
        held = [x for x in gc.get_objects() if isinstance(x, defaultdict) and any(isinstance(w, str) and w.startswith(" kept") for w in x)]
    finally:
        gc.enable()
    assert len(held) == 1


def test_a_bound_on_words_holds_within_a_batch(monkeypatch):
    """Portions give the ids of one batch, and a batch of many new words doesn't outgrow the bound by more than a portion."""
    monkeypatch.setattr(tokenstore, "PORTION_CHARS", 2000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", *(" ".join(f"t{k}w{j}" for j in range(100)) for k in range(60)), "x" * 9000, ""]
    bounded = tokenstore.token_arrays(texts, path, True, 1, 777)
    assert [x.tolist() for x in bounded] == [x.tolist() for x in tokenstore.token_arrays(texts, path, True, 1)]
    assert len(encoder(path, True, 777).known) < 777 + 600
