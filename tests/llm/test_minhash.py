import itertools

import numpy as np

from folioforge.llm.common import window_hashes, words_of
from folioforge.llm.minhash import BANDS, ROWS, UNIVERSE, components, near_duplicates, signature


def brute(rows, size, percent):
    """doc_id to (set size, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_like_all_pairs(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, rng.integers(20, 150)))
        for _ in range(8):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, max(2, len(own) // 15))):
                own[at] = rng.choice(vocabulary)
            rows.append((i, " ".join(own)))
            i += 1
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  Two"), (1005, "one two three"), (1006, rows[0][1].upper()), (1007, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, size=size).collect()}
        assert got == brute(rows, size, 80)


def test_repeated_rows_nulls_and_other_columns(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", 1), (3, "a b c d e f", 2), (None, "a b c d e f", 3), (5, "A b c d e f", None)], "doc_id long, text string, node int")
    rows = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert rows == [(0, 3, False), (3, 3, True), (3, 3, True), (5, 3, False)]


def test_texts_that_share_an_id(spark):
    """Each text of a reused id is linked on its own: 6 is like the second text of 1, 5 like the first."""
    a, b = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(100))
    docs = spark.createDataFrame([(1, a), (1, b), (5, a + " z"), (6, b + " z"), (9, "other words here entirely now")], "doc_id long, text string").repartition(3)
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (1, 1), (5, 1), (6, 1), (9, 9)]
    groups = {(r.doc_id, r.row): r.group for r in rows}
    assert len(set(groups.values())) == 3 and len(groups) == 5


def test_null_ids_are_linked(spark):
    a = " ".join(f"a{k}" for k in range(100))
    docs = spark.createDataFrame([(None, a), (None, a + " z"), (7, a + " y"), (None, "one two three four five six"), (None, None), (None, "")], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted(str((r.component_id, r.kept)) for r in rows) == ["(7, False)", "(7, False)", "(7, True)", "(None, False)", "(None, False)", "(None, False)"]
    assert sum(r.group is None for r in rows) == 2


def test_large_classes_and_late_pairs(spark, monkeypatch):
    """Names of large classes by broadcast, and links that pivots miss: a bucket with one pivot, many members of one component, a few others."""
    from folioforge.llm import minhash

    monkeypatch.setattr(minhash, "LARGE", 3)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    rng = np.random.default_rng(14)
    rows, i = [], 0
    for _ in range(6):
        base = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        for share in (0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2):
            for _ in range(4):
                own = [w if rng.random() > share else f"v{rng.integers(0, 10**6)}" for w in base]
                rows.append((i, " ".join(own)))
                i += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=3).collect()}
    assert got == brute(rows, 3, 80)


def test_late_pairs_like_all_pairs(spark):
    """The prefix filter keeps every pair of different labels that is similar enough."""
    from folioforge.llm.minhash import _late_pairs

    rng = np.random.default_rng(15)
    sets = []
    for g in range(8):
        core = rng.choice(10**6, 60, replace=False)
        for _ in range(12):
            keep = core[rng.random(60) > rng.choice([0.02, 0.1, 0.2])]
            sets.append(sorted({*keep.tolist(), *rng.choice(10**9, rng.integers(0, 12)).tolist()}))
    label = rng.integers(0, 20, len(sets)).tolist()
    df = spark.createDataFrame([(k, label[k], s) for k, s in enumerate(sets)], "node long, label long, items array<long>")
    got = {tuple(sorted((r.a, r.b))) for r in _late_pairs(df, 80).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if label[a] != label[b] and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert want and want <= got and all(label[a] != label[b] for a, b in got)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    """Ids that rise then fall, and random ids: each chain is one component, however many nodes it has."""
    n = 3000
    chains = [[*range(0, n, 2), *range(n - 1, 0, -2)], (n + np.random.default_rng(5).permutation(n)).tolist()]
    edges = spark.createDataFrame([e for c in chains for e in itertools.pairwise(c)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {k: k // n * n for k in range(2 * n)}


def test_circulant_signature():
    """Each coordinate is the minimum of one permutation, shifted by one more each time, over scattered positions."""
    s = np.unique(window_hashes(words_of("to be or not to be that is the question"), 2))
    sig = signature(s)
    assert sig.shape == (BANDS * ROWS,) and (sig < UNIVERSE).all()
    many = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64))
    a, b = many[:1800], many[200:]
    assert abs((signature(a) == signature(b)).mean() - 0.8) < 0.1
