import hashlib
import math

import numpy as np
import pytest

from quillon.llm import centroids

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, `Distance` int, `a.b` string"


def brute(rows, k, dims, rounds, scale=1024, seed=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) by plain loops."""
    kept = [
        (i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centers = [list(v) for _, v in sorted(kept, key=name)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centers[n] = [sum(xs) // len(vs) for xs in zip(*vs, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    fit = lambda xs: None if max(*xs, sum(xs)) >= 2**63 else sum(xs)
    out = []
    for i, d, n in found:
        sha = hashlib.sha256(",".join(map(str, centers[n])).encode()).hexdigest()
        own, every = [x for _, x, m in found if m == n], [x for _, x, _ in found]
        out.append((i, n, fit([d, 0]), fit([*own, 0]), fit([*every, 0]), sha))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def run(df, **how):
    found = centroids.cluster(df, **how)
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=key)


def test_equals_plain_loops(make):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=6).round(2).tolist()) for i in range(300)]
    df = make([(*x, "c", 1, "d") for x in rows], SCHEMA).repartition(4)
    assert run(df, k=5, dims=6, rounds=4) == sorted(brute(rows, 5, 6, 4), key=key)


def test_odd_vectors(make):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [3.0, -4.0]), (3, None), (4, [1.0]),
        (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.5, 0.5]),
        (None, None), (10, [-0.0001, 0.0001]), (1, [2.0, 2.0]), (11, []),
    ]
    df = make([(*x, None, None, None) for x in rows], SCHEMA)
    assert run(df, k=3, dims=2, rounds=3) == sorted(brute(rows, 3, 2, 3), key=key)
    assert run(df, k=50, dims=2, rounds=2) == sorted(brute(rows, 50, 2, 2), key=key)
    found = centroids.cluster(df, k=3, dims=2)
    assert found.columns == ["vec_id", "embedding", "a.b", *centroids.ADDED]
    assert run(df.where("vec_id = 99"), dims=2) == []


def test_very_large_components_are_exact(make):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e300, -1e300, 1.7e308, 3e20, 5.0, 2.0**60, 1e300])]
    df = make([(*x, None, None, None) for x in rows], SCHEMA)
    assert run(df, k=3, dims=2, rounds=3) == sorted(brute(rows, 3, 2, 3), key=key)


@pytest.mark.parametrize("dims, k, spread", [(1, 9, 5), (2, 30, 40), (8, 8, 3), (64, 4, 1000)])
def test_assign_with_ties(dims, k, spread):
    r = np.random.default_rng(dims)
    x, c = r.integers(-spread, spread, (400, dims)), r.integers(-spread, spread, (k, dims))
    who, best = centroids.assign(x, centroids.sorted_lists(c.tolist(), dims, False))
    exact = ((x[:, None] - c) ** 2).sum(axis=2)
    assert who.tolist() == exact.argmin(axis=1).tolist()
    assert best.tolist() == exact.min(axis=1).tolist()
