"""Whitening and clustering of vectors, against plain numpy and Python, on awkward tables."""

import hashlib
import math

import numpy as np
import pytest

from graphlake.llm import clustering, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, label int, x array<string>, cluster string, n string, component string, place string"


def table(spark, rows, schema=SCHEMA):
    """Rows (vec_id, embedding) with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, v, 1, ["x"], "c", "n", "k", "p") for i, v in rows], schema)


def vectors(n, d, seed, spread=None):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, d)) * (np.ones(d) if spread is None else spread)
    return [[float(np.float32(v)) for v in row] for row in m]


def awkward(d):
    """Vectors that no operator keeps."""
    return [None, [], [NAN] + [0.5] * (d - 1), [INF] + [0.5] * (d - 1), [0.5] * (d - 1) + [-INF], [0.5, None] + [0.5] * (d - 2)]


# ---------------------------------------------------------------- whitening


def whole(v, scale, shift):
    return [math.floor(scale * float(c)) + shift for c in v]


def whitened_plainly(rows, k=16):
    """(n, V's eigenvalues, eigenvectors, {row: deviation}) by exact sums and a full decomposition."""
    xs = {i: whole(v, 64, 1_000_000) for i, v in rows}
    fit = sorted({tuple(x) for x in xs.values()})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - sums[j]) / n for j in range(d)] for x in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in xs.items()}
    return n, sums, values[::-1][:k], basis[:, ::-1][:, :k], float(np.trace(centred.T @ centred / n)), deviation, xs


@pytest.mark.parametrize("spread", ["flat", "falling"])
def test_whiten(spark, spread):
    d = 32
    kept = vectors(300, d, 3, None if spread == "flat" else 0.5 ** np.arange(d).clip(0, 18) * 40)
    rows = list(enumerate(kept)) + [(1000 + i, kept[7]) for i in range(150)] + [(5, kept[5]), (None, kept[9]), (None, kept[9])]
    bad = [(2000 + i, v) for i, v in enumerate([*awkward(d), [0.5] * (d + 1), [1e300] * d])]
    got = whitening.whiten(table(spark, rows + bad)).collect()
    n, sums, values, basis, trace, deviation, xs = whitened_plainly(rows)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, k) for i, _ in rows for k in range(1, 17))
    for r in got:
        assert r.n == n and int(r.deviation) == deviation[r.vec_id] and r.identity_error < 1e-6
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-9)
        x = (n * np.array(xs[r.vec_id], dtype=float) - np.array(sums, dtype=float)) / n
        want = x @ basis[:, r.component - 1] / math.sqrt(values[r.component - 1])
        assert math.isclose(abs(r.whitened), abs(want), rel_tol=1e-6, abs_tol=1e-6)
    # one sign for all rows of a component
    for k in range(16):
        signs = {np.sign(r.whitened * ((n * np.array(xs[r.vec_id], dtype=float) - np.array(sums, dtype=float)) @ basis[:, k])) for r in got if r.component == k + 1 and abs(r.whitened) > 1e-3}
        assert len(signs) == 1


def test_the_range_finder_stops_or_expands():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    for spectrum, full in ((0.25 ** np.arange(64), False), (np.linspace(1.1, 1, 64), True)):
        matrix = turn * spectrum @ turn.T
        values, found, made, width = whitening.components_of(lambda q, m=matrix: m @ q, 64, 16, passes=12)
        assert (width == 64) == full and made <= 13
        assert np.allclose(values, spectrum[:16], rtol=1e-9, atol=1e-14)
        sure = 8 if not full else 16
        assert np.allclose(np.abs((turn[:, :sure] * found[:, :sure]).sum(axis=0)), 1, atol=1e-7)


def test_whiten_small_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    # one distinct vector has no direction; two have one
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0, 4.0])])).collect()
    assert {(r.vec_id, r.component, r.n, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two} == {(i, 1, 2, 1.0, 1.0) for i in (1, 2, 3)}
    assert sorted(int(r.deviation) for r in two) == [128**2] * 3
    # entries so large that squares pass a long
    huge = whitening.whiten(table(spark, [(1, [2.0**40, 0.0]), (2, [-(2.0**40), 0.0]), (3, [0.0, 1.0])])).collect()
    x = [[2**46 + 10**6, 10**6], [-(2**46) + 10**6, 10**6], [10**6, 64 + 10**6]]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert {r.vec_id: int(r.deviation) for r in huge} == dict(zip((1, 2, 3), want))


# ---------------------------------------------------------------- clustering


def clustered_plainly(rows, k=40, rounds=5):
    """Every distance of every round, in Python's integers; rows are (id, vector), in the order given."""
    xs = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(xs, key=key)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, x in xs:
            members.setdefault(nearest(x)[1], []).append(x)
        centroids = [tuple(sum(col) // len(members[j]) for col in zip(*members[j])) if j in members else c for j, c in enumerate(centroids)]
    final = [(i, nearest(x)) for i, x in xs]
    inertia = {}
    for _, (d, j) in final:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i is None, i or 0), j, d, inertia[j], sum(inertia.values()), digest[j]) for i, (d, j) in final)


def rows_of(df):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_cluster(spark):
    rng = np.random.default_rng(9)
    kept = vectors(160, 64, 4)
    # coarse vectors make ties of distances; a hot vector; repeated ids; null ids; empty clusters by equal starts
    ties = [[float(c) for c in rng.integers(-1, 2, 64) / 256] for _ in range(60)]
    rows = list(enumerate(kept + ties)) + [(500 + i, kept[3]) for i in range(90)] + [(7, kept[8]), (None, kept[1]), (None, ties[0])]
    bad = [(3000 + i, v) for i, v in enumerate([*awkward(64), [0.5] * 63, [0.5] * 65, [1e300] * 64])]
    assert rows_of(clustering.cluster(table(spark, rows + bad))) == clustered_plainly(rows)
    assert rows_of(clustering.cluster(table(spark, rows), clusters=300, rounds=2)) == clustered_plainly(rows, 300, 2)


def test_cluster_small_tables(spark):
    assert clustering.cluster(table(spark, [])).count() == 0
    assert clustering.cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0
    same = [(i, [0.25] * 64) for i in range(5)]
    assert rows_of(clustering.cluster(table(spark, same))) == clustered_plainly(same)
    # integers too large for exact doubles
    wide = [(i, [float(i % 3) * 3e4 + j for j in range(64)]) for i in range(6)]
    assert rows_of(clustering.cluster(table(spark, wide, SCHEMA.replace("float", "double")), clusters=2)) == clustered_plainly(wide, 2)


def test_sort_means_saves_distances():
    """Rows near their centroid meet few others, and results are those of all distances."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-500, 500, (30, 64))
    x = np.concatenate([c + rng.integers(-20, 20, (50, 64)) for c in centres])
    before = np.repeat(np.arange(30), 50)
    cluster, distance, computed = clustering.Centroids([list(map(int, c)) for c in centres]).assign(x, before)
    every = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert computed < 3 * len(x)
    # a centroid at exactly twice the distance is looked at: a tie goes to the smaller number
    line = clustering.Centroids([[0], [4]])
    assert line.assign(np.array([[2]]), np.array([1]))[0].tolist() == [0]
