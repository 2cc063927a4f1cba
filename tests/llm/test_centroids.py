"""Clustering against all distances in plain integers."""

import hashlib

import numpy as np
import pytest

from folioforge.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, v string, x int"


def brute(rows, k, rounds, dim, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    means = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))

    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(near(v)[1], []).append(v)
        for c, members in by.items():
            means[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    own = {c: sum(d for _, d, x in found if x == c) for _, _, c in found}
    return [(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in found]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize(("n", "dim", "spread"), [(400, 6, 1.0), (300, 3, 0.02), (5, 4, 1.0), (200, 5, 2000.0)])
def test_same_as_all_distances(spark, n, dim, spread):
    r = np.random.default_rng(n)
    rows = [(int(i), (spread * r.normal(size=dim) * r.choice([0.2, 1, 3])).tolist()) for i in range(n)]
    rows += [rows[0], (None, rows[1][1]), (n, None), (n + 1, rows[2][1][:-1]), (n + 2, [*rows[3][1][:-1], float("nan")]), (n + 3, [*rows[3][1][:-1], float("inf")]), (n + 4, [*rows[3][1][:-1], None])]
    rows += [(n + 5 + i, [0.5] * dim) for i in range(n // 3)]
    vectors = spark.createDataFrame([(i, v, 1, "c", "v", 3) for i, v in rows], SCHEMA).repartition(5)
    got = centroids.cluster(vectors, k=8, rounds=3, dim=dim)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 8, 3, dim, 64), key=key)


def test_nearest_with_ties_on_the_boundary():
    r = np.random.default_rng(3)
    for top in (2, 50, 1 << 22):
        x, c = (r.integers(-top, top + 1, (n, 3)) for n in (3000, 40))
        c[7], c[30], x[0] = c[3], -c[3], 0
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        number, distance = centroids.nearest(x, c)
        assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_empty_and_far(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none).collect() == []
    assert centroids.cluster(none).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(spark.createDataFrame([(1, [1.0], 1, "", "", 1)], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0], 1, "", "", 1)], SCHEMA), dim=2).collect()
