"""Clustering and whitening against plain versions in exact or wide arithmetic, on tables with nulls, ties and odd vectors."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galvan.llm import centroids, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, part string, cluster int, component int"


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "a", "b", 9, 9) for i, v in vectors], SCHEMA).repartition(3)


def vectors_of(n, dim=64, seed=1):
    return [(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(seed).normal(0, 0.2, (n, dim)).astype(np.float32))]


def odd(dim=64):
    return [(90, None), (91, []), (92, [0.5] * (dim - 1)), (93, [0.5] * (dim - 1) + [None]), (94, [float("nan")] + [0.0] * (dim - 1)), (95, [float("-inf")] + [0.0] * (dim - 1))]


def brute_clusters(rows, k=8, rounds=10, seed=3):
    """Plain integers, one vector at a time."""
    kept = [(i, [math.floor(Fraction(c) * 1024) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    cents = [list(v) for _, v in order[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min(range(len(cents)), key=lambda j: (distance(v, cents[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v), []).append(v)
        for j, vs in groups.items():
            cents[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    last = [(i, best(v), distance(v, cents[best(v)])) for i, v in kept]
    inertia = {j: sum(d for _, c, d in last if c == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in last), key=str)


def clusters(df, **more):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(df, **more).collect()), key=str)


def test_clusters_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.query(spark, DATA).collect()), key=str) == brute_clusters(rows)


def test_clusters_with_nulls_ties_and_repeats(spark):
    v = vectors_of(40)
    rows = v + odd() + [(None, v[0][1]), (3, v[3][1]), (3, v[3][1]), (50, v[7][1]), (51, [-x for x in v[7][1]])]
    assert clusters(table_of(spark, rows)) == brute_clusters(rows)


def test_few_or_no_vectors(spark):
    rows = vectors_of(3) + odd()
    assert clusters(table_of(spark, rows)) == brute_clusters(rows)
    assert clusters(table_of(spark, odd())) == []
    assert centroids.cluster(table_of(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "size"]


def test_large_components_take_the_integer_path(spark):
    rows = vectors_of(30) + [(100 + i, [float(np.float32(x * 10.0**e)) for x in v]) for i, (e, (_, v)) in enumerate(zip([3, 5, 6, 7, 4], vectors_of(5, seed=2), strict=True))]
    assert clusters(table_of(spark, rows)) == brute_clusters(rows)
    huge = [*rows, (200, [float(np.float32(3e38))] + [0.0] * 63)]
    got = {r.vec_id: r for r in centroids.cluster(table_of(spark, huge)).collect()}
    assert {i: r.cluster for i, r in got.items()} == {r[0]: r[1] for r in brute_clusters(huge)}
    assert all(r.inertia is None or r.inertia >= 0 for r in got.values())


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(-(2**40), 2**40), min_size=3, max_size=3), min_size=1, max_size=8), st.lists(st.lists(st.integers(-(2**34), 2**34), min_size=3, max_size=3), min_size=1, max_size=4))
def test_nearest_is_exact(x, c):
    cluster, d = centroids.nearest(np.array(x, np.float64), c)
    for row, j, found in zip(x, cluster, d, strict=True):
        every = [sum((a - b) ** 2 for a, b in zip(row, q, strict=True)) for q in c]
        assert found == min(every) and j == every.index(min(every))


def brute_whitening(rows, dim=64):
    kept = [(i, [math.floor(Fraction(c) * 64) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    n = len(kept)
    s = [sum(v[j] for _, v in kept) for j in range(dim)]
    centred = np.array([[n * v[j] - s[j] for j in range(dim)] for _, v in kept], object)  # exact
    cov = np.array((centred.T @ centred), dtype=object)
    v = np.array([[float(Fraction(int(x), n**3)) for x in row] for row in cov])
    e, a = np.linalg.eigh(v)
    return kept, n, [int((row * row).sum()) for row in centred], v, e[::-1], a[:, ::-1], centred


@pytest.mark.parametrize("case", ["table", "odd"])
def test_whitening(spark, case):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()] if case == "table" else vectors_of(150) + odd() + [(None, [0.25] * 64), (3, [0.125] * 64), (3, [0.125] * 64)]
    got = (whitening.query(spark, DATA) if case == "table" else whitening.whiten(table_of(spark, rows))).collect()
    kept, n, deviations, v, e, a, centred = brute_whitening(rows)
    assert len(got) == 32 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for (i, _), d in zip(kept, deviations, strict=True))
    for k in range(1, 33):
        mine = sorted((str(r.vec_id), r.deviation, r.whitened) for r in got if r.component == k)
        want = sorted((str(i), d, float(w)) for (i, _), d, w in zip(kept, deviations, (centred.astype(float) / n) @ a[:, k - 1] / e[k - 1] ** 0.5, strict=True))
        x, y = np.array([m[2] for m in mine]), np.array([m[2] for m in want])
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-6
        assert [*{r.explained for r in got if r.component == k}] == [pytest.approx(e[k - 1] / np.trace(v), rel=1e-9)]


def test_whitening_without_variation(spark):
    got = whitening.whiten(table_of(spark, [(1, [0.5] * 4), (2, [0.5] * 4), (3, [1.0] * 3)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(2, 0, None, None, None)] * 8
    flat = whitening.whiten(table_of(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])]), components=2).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.vec_id, r.component))] == [False, True] * 3 and max(r.identity_error for r in flat) < 1e-12
    assert whitening.whiten(table_of(spark, odd()[:2])).collect() == [] and whitening.whiten(table_of(spark, [])).collect() == []


def test_products_have_no_rounding():
    y = np.random.default_rng(5).normal(0, 1, (500, 6)) * 10.0 ** np.random.default_rng(6).integers(-6, 6, (500, 6))
    exact = [[sum(Fraction(a) * Fraction(b) for a, b in zip(p, q, strict=True)) for q in y.T.tolist()] for p in y.T.tolist()]
    hi, lo = whitening.outer_sums(y)
    for i in range(6):
        for j in range(6):
            scale = sum(abs(a * b) for a, b in zip(y[:, i], y[:, j], strict=True))
            assert abs(Fraction(hi[i, j]) + Fraction(lo[i, j]) - exact[i][j]) <= Fraction(scale) * Fraction(1, 2**75) + Fraction(np.abs(y).max() ** 2) * Fraction(1, 2**70)


def test_large_sums_and_deviations():
    x = np.array([[2**61, 5], [-(2**61), 7]], np.int64)
    assert whitening.column_sums(x) == [0, 12] and whitening.deviations(x, 2, [0, 12]) == [None, None]
    assert whitening.deviations(np.array([[1, 2]]), 3, [4, 5]) == [2]
