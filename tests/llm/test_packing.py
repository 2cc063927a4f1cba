import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioforge.llm.packing import Limits, pack, pack_window, reply_share

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, sizes, shares, limits):
    seen = {k: np.zeros(n, int) for k, n in enumerate(sizes)}
    sequences = {}
    for k, at, n, sequence, offset in pieces:
        assert n > 0
        seen[k][at : at + n] += 1
        sequences.setdefault(sequence, []).append((offset, n, k))
    assert all((x == 1).all() for x in seen.values())
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]]
        total = sum(p[1] for p in parts)
        assert total <= limits.tokens and total & (total - 1) == 0
        assert len(parts) <= limits.segments
        assert sum(np.ceil((n - 1) * shares[k] - 1e-9) for _, n, k in parts) <= limits.loss


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.sampled_from([0.0, 0.3, 1.0])), max_size=40), st.sampled_from([Limits(64, 4, 40), Limits(64, 64, 64), Limits(32, 2, 5), Limits(1, 1, 1)]))
def test_limits_hold_and_nothing_is_lost(examples, limits):
    sizes, shares = [e[0] for e in examples], np.array([e[1] for e in examples])
    check(pack_window(np.array(sizes, dtype=np.int64), shares, limits), sizes, shares, limits)


def test_pack_documents(spark):
    texts = [None, "", "one", "two words.\nA line", "x" * 5000, "mot à mot " * 3000, "one", "😀 \t  odd"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(2, "one", "y", 2), (None, "no id", None, None)], "doc_id long, text string, start string, ids int")
    rows = pack(docs, PATH, True, 1).toPandas()
    own = Tokenizer.from_file(PATH)
    for k, t in enumerate(texts):
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = rows[rows.doc_id == k].sort_values("start")
        assert set(mine.doc_tokens) == {len(ids)}
        if k == 2:
            assert len(mine) >= 2
            continue
        assert np.concatenate(mine.ids.to_list()).tolist() == ids.tolist()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert rows.doc_id.isna().any()
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        assert s.length.sum() in [1 << k for k in range(12)]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH, True, 1).count() == 0


def test_loss_column(spark):
    docs = spark.createDataFrame([(1, "a b c d", 0.5), (2, "e f", None)], "doc_id long, text string, share double")
    for r in pack(docs, PATH, True, 1, loss=F.col("share")).collect():
        assert r.loss_tokens == np.ceil((r.length - 1) * (0.5 if r.doc_id == 1 else 1))


def first_fit(sizes, shares, limits):
    """Sequences that first fit makes of the same examples, without padding too: whole ones in order, the first that fits; a rest is cut in two."""
    todo, count = [(n, s) for n, s in zip(sizes.tolist(), shares.tolist(), strict=True) if n], 0
    while todo:
        room, slack, segments, at, taken = limits.tokens, limits.loss, limits.segments, 0, []
        while at < len(todo) and segments and room:
            n, s = todo[at]
            if n <= room and np.ceil((n - 1) * s) <= slack:
                room, slack, segments = room - n, slack - np.ceil((n - 1) * s), segments - 1
                taken.append(todo.pop(at))
            else:
                at += 1
        if room and segments and todo:  # the first of the rest is cut to what is left
            n, s = todo[0]
            part = int(min(n, room, slack // max(s, 1e-9) + 1))
            room, todo[0] = room - part, (n - part, s)
            taken.append((part, s))
        used = sum(n for n, _ in taken)
        over = used - (1 << (used.bit_length() - 1))
        for n, s in reversed(taken):
            back = min(over, n)
            over -= back
            if back:
                todo.append((back, s))
        todo, count = [x for x in todo if x[0]], count + 1
    return count


def test_limits_bind_and_the_dot_product_needs_fewer_sequences_than_first_fit():
    rng = np.random.default_rng(9)
    sizes, shares = np.exp(rng.normal(6.2, 0.7, 1500)).astype(np.int64), np.clip(rng.normal(0.55, 0.3, 1500), 0, 1)
    limits = Limits(2048, 8, 1280)
    pieces = pack_window(sizes, shares, limits)
    check(pieces, sizes.tolist(), shares, limits)
    loss, segments = {}, {}
    for k, _, n, s, _ in pieces:
        loss[s], segments[s] = loss.get(s, 0) + np.ceil((n - 1) * shares[k]), segments.get(s, 0) + 1
    assert sum(v > 0.98 * limits.loss for v in loss.values()) > 0.1 * len(loss) and max(segments.values()) == limits.segments
    assert len(loss) < first_fit(sizes, shares, limits)


def test_reply_share():
    assert [reply_share(t) for t in ("q\nabc", "one", "", "\n", "é\nb\ncc\n")] == [0.75, 1.0, 1.0, 1.0, 0.25]
