"""Centroid clustering and whitening against plain numpy, on hostile small tables."""

import hashlib

import numpy as np
import pytest

from spanmill.llm import centroids, whitening

CLASHING = "vec_id bigint, embedding array<double>, cluster int, x string, block int, part string, dims int, rows int, distance string"


def frame(spark, pairs, kind="double"):
    if kind == "clashing":
        return spark.createDataFrame([(i, v, 1, "x", 2, "p", 3, 4, "d") for i, v in pairs], CLASHING)
    return spark.createDataFrame(pairs, f"vec_id bigint, embedding array<{kind}>")


def hostile(dims, n=300, seed=5):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(size=(n, dims)) * draw.uniform(0.1, 3, dims)
    vectors[n // 2 :] = vectors[0]  # half of the table is one vector
    pairs = [(i, v.tolist()) for i, v in enumerate(vectors)]
    pairs += [(0, vectors[0].tolist()), (7, vectors[7].tolist()), (7, vectors[8].tolist()), (None, vectors[9].tolist())]
    bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [None] * dims, [float("nan")] + [0.1] * (dims - 1), [0.1] * (dims - 1) + [float("-inf")], [0.25] * 5000]
    return pairs, pairs + [(9000 + k, v) for k, v in enumerate(bad)]


def lloyd(pairs, dims, count, rounds):
    bound = centroids.limit(dims)
    points = [(i, [max(-bound, min(bound, int(np.floor(64 * c)))) for c in v]) for i, v in pairs]
    drawn = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in points if i is not None)[:count]
    middle = [x for _, x in drawn]

    def closest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        members = {}
        for _, x in points:
            members.setdefault(closest(x)[1], []).append(x)
        middle = [[sum(column) // len(members[k]) for column in zip(*members[k], strict=True)] if k in members else c for k, c in enumerate(middle)]
    found = [(i, *closest(x)) for i, x in points]
    of_cluster = {}
    for _, d, k in found:
        of_cluster[k] = of_cluster.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, k, d, of_cluster[k], sum(of_cluster.values()), digest[k]) for i, d, k in found), key=str)


@pytest.mark.parametrize("kind", ["double", "clashing"])
@pytest.mark.parametrize("dims,count", [(64, 16), (3, 5), (1, 4)])
def test_clustering_equals_lloyd(spark, dims, count, kind):
    good, every = hostile(dims)
    got = centroids.cluster(frame(spark, every, kind), dims, count)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == lloyd([p for p in every if p[1] and len(p[1]) == dims and all(c is not None and np.isfinite(c) for c in p[1])], dims, count, 3)


def test_search_leaves_nothing_out_and_saves_work():
    draw = np.random.default_rng(1)
    middle = draw.integers(-300, 300, (200, 16)) + draw.integers(-400, 400, (200, 1))
    middle[50:60] = middle[40]  # equal centroids: the smaller number wins
    x = np.concatenate([middle[::3], middle[draw.integers(0, 200, 3000)] + draw.integers(-60, 60, (3000, 16)), np.zeros((1, 16), np.int64)])
    number, distance, compared = centroids.nearest(x, centroids.rank(middle))
    every = ((x[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert compared < len(x) * len(middle) / 4


def test_clustering_of_few_and_huge_vectors(spark):
    assert centroids.cluster(frame(spark, [], "float")).count() == 0
    assert centroids.cluster(frame(spark, [(None, [0.5] * 64)])).count() == 0
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    assert sorted(map(tuple, centroids.cluster(frame(spark, huge)).collect()), key=str) == lloyd([(i, v) for i, v in huge], 64, 16, 3)


def plain_whitening(pairs, components=8):
    ids = [i for i, _ in pairs]
    x = np.floor(1024 * np.array([v for _, v in pairs], np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    order = order[values[order] > 1e-12 * values.max()]
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return ids, exact, (centred @ directions[:, order]) / np.sqrt(values[order]), values[order] / np.trace(covariance)


@pytest.mark.parametrize("dims,block", [(64, 32), (12, 7), (2, 1000)])
def test_whitening_equals_numpy(spark, dims, block):
    _, every = hostile(dims)
    usable = [(i, v) for i, v in every if v and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    got = whitening.whiten(frame(spark, every, "clashing").repartition(5), rows_per_block=block).collect()
    ids, exact, scores, shares = plain_whitening(usable)
    assert len(got) == len(usable) * len(shares)
    assert {r["n"] for r in got} == {len(usable)} and {r["identity_error"] for r in got}.pop() < 1e-9
    for c, share in enumerate(shares, 1):
        mine = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == c)
        assert all(abs(r["explained"] - share) < 1e-9 for r in got if r["component"] == c)
        fits = []
        for sign in (1, -1):
            wanted = sorted((str(i), d, s) for i, d, s in zip(ids, exact, sign * scores[:, c - 1], strict=True))
            fits.append([w[:2] for w in wanted] == [m[:2] for m in mine] and np.allclose([w[2] for w in wanted], [m[2] for m in mine], atol=1e-7))
        assert any(fits)


def test_whitening_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, []), (3, [float("nan")])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).count() == 0
    assert whitening.whiten(frame(spark, [(k, [0.5, 0.25]) for k in range(20)], "float")).count() == 0
    line = whitening.whiten(frame(spark, [(k, [k / 4, 0.25]) for k in range(20)])).collect()
    assert {r["component"] for r in line} == {1} and len(line) == 20


def test_whitening_of_huge_entries(spark):
    got = whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])])).collect()
    ids, exact, _, _ = plain_whitening([(1, [2.0**31, 0.0]), (2, [-(2.0**31), 1.0]), (3, [5.0, 2.0])])
    wanted = {i: d if d < 1 << 63 else None for i, d in zip(ids, exact, strict=True)}
    assert {r["vec_id"]: r["deviation"] for r in got} == wanted
