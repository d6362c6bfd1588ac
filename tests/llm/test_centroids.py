import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import centroids as ce

COLUMNS = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, dims):
    kept = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    draw = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    at = [v for _, v in sorted(kept, key=lambda r: (draw(r[0]), r[1]))[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        near = [min(range(len(at)), key=lambda j: (dist(v, at[j]), j)) for _, v in kept]
        if r < rounds:
            for j in range(len(at)):
                mine = [v for (_, v), n in zip(kept, near) if n == j]
                if mine:
                    at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    d = [dist(v, at[n]) for (_, v), n in zip(kept, near)]
    inertia = {j: sum(x for x, n in zip(d, near) if n == j) for j in set(near)}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted([(i, n, x, inertia[n], sum(d), sha[n]) for (i, _), n, x in zip(kept, near, d)], key=str)


def odd_rows(dims):
    return [
        (None, [0.5] * dims), (None, [0.5] * dims), (3, [0.25] * dims), (3, [0.25] * dims), (9001, None), (9002, []),
        (9003, [1.0] * (dims - 1)), (9004, [1.0] * (dims - 1) + [None]), (9005, [float("nan")] + [1.0] * (dims - 1)),
        (9006, [float("-inf")] + [1.0] * (dims - 1)), (9007, [-0.001] * dims), (9008, [1e5] * dims),
    ]


@pytest.mark.parametrize("k,spread", [(16, 1.0), (7, 0.02), (1, 1.0)])
def test_equals_plain_rounds(spark, k, spread):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-2, 0, 3]) + rng.gauss(0, spread) for _ in range(4)]) for i in range(300)] + odd_rows(4)
    df = spark.createDataFrame(rows, COLUMNS).withColumn("cluster", F.lit("x")).withColumn("near", F.lit(1))
    for parts in (1, 5):
        got = ce.clusters(df.repartition(parts), k=k, dims=4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, 3, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.0])]
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted((tuple(r) for r in ce.clusters(df, dims=2).collect()), key=str) == brute(rows, 16, 3, 2)
    assert ce.clusters(df.where("false"), dims=2).count() == 0
    assert ce.clusters(df, dims=3).collect() == []


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [3e6, 0.0])], COLUMNS)
    with pytest.raises(Exception, match="2\\^27"):
        ce.clusters(df, dims=2).collect()


@pytest.mark.parametrize("seed", range(6))
def test_search_is_exact_and_saves_distances(seed):
    rng = np.random.default_rng(seed)
    k, dims = int(rng.integers(2, 24)), int(rng.choice([1, 2, 16]))
    x = (rng.integers(0, 9, (40, 1, dims)) * 50 + rng.integers(-3, 4, (40, 20, dims))).reshape(-1, dims).astype(np.int64)
    at, before, known, taken = x[rng.permutation(len(x))[:k]].copy(), None, ce.first_places(len(x), k), 0
    for _ in range(5):
        known, n = ce.search(x, known, ce.centres(at, before))
        taken += n
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (known.near == d.argmin(1)).all()
        others = d.copy()
        others[np.arange(len(x)), known.near] = 1 << 60
        assert (known.lower <= np.sqrt(others.min(1)) * (1 + 1e-9)).all()
        assert (known.upper >= np.sqrt(d.min(1)) * (1 - 1e-9)).all()
        before, at = at, np.array([x[known.near == j].sum(0) // max(1, (known.near == j).sum()) if (known.near == j).any() else at[j] for j in range(k)])
    assert taken < len(x) * k * 5 or k < 4
