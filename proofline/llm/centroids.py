"""Centroid clustering (Lloyd's rounds) with the search that Shallot makes.

Components become integers, floor(scale * x), so distances and means are exact and
a result does not depend on how rows are dealt out. Every vector carries its nearest
and its second-nearest centroid of the round before, an upper bound of its distance
to the first and a lower bound of that to all others. When centroids move, the bounds
move with them, and a vector whose bounds still part, or that lies nearer to its
centroid than half the way to the next one, is done without a distance.

The others measure both remembered centroids and search around the closer one: its
neighbours come sorted by distance, and only those within the sum of the distances
to it and to the second-best so far can be nearer than that one. This ball shrinks
with each better second that turns up, and the search ends at the first neighbour
beyond it. Survivors are compared by squared distances in 64-bit integers, ties by
the smaller number. Bounds are floating point and are only believed with a margin.

Spark deals the rows out; a batch searches all its vectors at once, by starting
centroid. Vectors and their bounds are written once a round to the shared folder.
New means need only the vectors that changed their centroid: these are added up per
task, and what meets on the driver is one row per centroid and component.

Vectors that have another number of components than ``dims``, or a null or non-finite
one, are left out. Null and repeated ids are allowed, each row is a vector. Only id
and vector are read. With no vectors the result is empty; with fewer than ``k`` each
starts a centroid. A component of 2^27 or more after scaling is refused, as its
squared distances do not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import Scratch

MARGIN = 1e-9  # relative, far above the error of a few additions
LARGEST = 1 << 27


class Centres(NamedTuple):
    at: np.ndarray  # k x dims
    order: np.ndarray  # k x (k - 1): the others, nearest first
    gaps: np.ndarray  # k x (k - 1): how far these are
    moved: np.ndarray  # how far each has moved in the last round
    others: np.ndarray  # how far the others have moved at most


class Places(NamedTuple):
    near: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def centres(at: np.ndarray, before: np.ndarray | None = None) -> Centres:
    k = len(at)
    gaps = np.sqrt([squares(at, c) for c in at].copy() if k else np.zeros((0, 0)))
    np.fill_diagonal(gaps, -1)
    order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
    moved = np.zeros(k) if before is None else np.sqrt([squares(a[None], b)[0] for a, b in zip(at, before)])
    others = np.array([np.delete(moved, i).max(initial=0) for i in range(k)])
    return Centres(at, order, np.take_along_axis(gaps, order, 1), moved, others)


def squares(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances in 64-bit integers, to one vector or to one each."""
    d = vectors - to
    return np.einsum("ij,ij->i", d, d)


def _less(d: np.ndarray, i: np.ndarray, e: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (d < e) | ((d == e) & (i < j))


def first_places(n: int, k: int) -> Places:
    """What is known before the first round: nothing."""
    return Places(np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n))


def search(vectors: np.ndarray, known: Places, c: Centres) -> tuple[Places, int]:
    """The nearest centroid of each vector, and how many distances that took."""
    if len(c.at) == 1:
        return Places(known.near * 0, known.near * 0, known.upper, np.full(len(vectors), np.inf)), 0
    near, second = known.near.copy(), known.second.copy()
    upper = known.upper + c.moved[near]
    lower = known.lower - c.others[near]
    sure = np.maximum(lower, c.gaps[near, 0] / 2) * (1 - MARGIN)
    todo = np.flatnonzero(~(upper * (1 + MARGIN) < sure))
    best = squares(vectors[todo], c.at[near[todo]])
    taken = len(todo)
    upper[todo] = np.sqrt(best)
    open_ = ~(upper[todo] * (1 + MARGIN) < sure[todo])
    todo, best = todo[open_], best[open_]
    # Start from the closer of the two remembered ones.
    first, other = near[todo], second[todo]
    next_ = squares(vectors[todo], c.at[other])
    taken += len(todo)
    swap = _less(next_, other, best, first)
    first, other = np.where(swap, other, first), np.where(swap, first, other)
    best, next_ = np.where(swap, next_, best), np.where(swap, best, next_)
    for g in np.unique(first):
        rows = np.flatnonzero(first == g)
        mine = vectors[todo[rows]]
        start, known_other = np.sqrt(best[rows]), other[rows]
        b, bi, s, si = best[rows], np.full(len(rows), g, np.int32), next_[rows], known_other.copy()
        live = np.arange(len(rows))
        for j, gap in zip(c.order[g], c.gaps[g]):
            live = live[gap * (1 - MARGIN) <= (start[live] + np.sqrt(s[live])) * (1 + MARGIN)]
            if not len(live):
                break
            at = live[known_other[live] != j]
            d = squares(mine[at], c.at[j])
            taken += len(at)
            wins = _less(d, j, b[at], bi[at])
            places = ~wins & _less(d, j, s[at], si[at])
            w, p = at[wins], at[places]
            s[w], si[w] = b[w], bi[w]
            b[w], bi[w] = d[wins], j
            s[p], si[p] = d[places], j
        at = todo[rows]
        near[at], second[at], upper[at], lower[at] = bi, si, np.sqrt(b), np.sqrt(s)
    # Vectors done by their bounds keep the lower bound that has moved along.
    return Places(near, second, upper, lower), taken


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


STATE = "id {kind}, vector array<int>, was int, near int, second int, upper double, lower double"


def _assigned(rows: DataFrame, kind: str, c: Centres) -> DataFrame:
    """One round: ``rows`` with the nearest of the centroids, and the one before in ``was``."""
    shared = rows.sparkSession.sparkContext.broadcast(c)
    begun = "near" in rows.columns

    def run(batches):
        c = shared.value
        for batch in batches:
            x = _matrix(batch.column("vector"))
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError("a scaled component is 2^27 or more: squared distances do not fit 64 bits")
            if begun:
                known = Places(*(batch.column(n).to_numpy() for n in Places._fields))
            else:
                known = first_places(len(x), len(c.at))
            found, _ = search(x, known, c)
            was = batch.column("near") if begun else pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("vector").cast(pa.list_(pa.int32())), was,
                    pa.array(found.near, pa.int32()), pa.array(found.second, pa.int32()), pa.array(found.upper), pa.array(found.lower),
                ],
                names=["id", "vector", "was", *Places._fields],
            )

    return rows.mapInArrow(run, STATE.format(kind=kind))


def _changes(rows: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the last round added to each centroid's sums and count."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("vector"))
            for name, sign in (("near", 1), ("was", -1)):
                at = batch.column(name)
                here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                to = at.drop_null().to_numpy()
                for j in np.unique(to):
                    mine = here[to == j]
                    sums[j] += sign * x[mine].sum(0)
                    n[j] += sign * len(mine)
        some = np.flatnonzero(sums.any(1) | (n != 0))
        both = np.column_stack([n, sums])[some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(both), pa.list_(pa.int64()))], names=["near", "sums"])

    moved = rows.where("was is null or was <> near").select("vector", "near", "was")
    parts = moved.mapInArrow(run, "near int, sums array<bigint>").select("near", F.posexplode("sums").alias("i", "x"))
    total = parts.groupBy("near", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = np.zeros((k, dims + 1), object)
    for r in total:
        out[r["near"], r["i"]] = int(r["x"])
    return out[:, 1:], out[:, 0]


def _measured(rows: DataFrame, kind: str, at: np.ndarray) -> DataFrame:
    """(id, cluster, distance)."""
    shared = rows.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        at = shared.value
        for batch in batches:
            near = batch.column("near")
            d = squares(_matrix(batch.column("vector")), at[near.to_numpy()]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), near, pa.array(d, pa.int64())], names=["id", "cluster", "distance"])

    return rows.select("id", "vector", "near").mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def clusters(
    table: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: float = 64,
    seed: int = 1,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """A row per vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``seed:id``; after
    ``rounds`` rounds of assigning and averaging, vectors are assigned once more.
    """
    x = F.col("vector")
    whole = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = (
        table.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        .where(x.isNotNull() & F.coalesce(whole, F.lit(False)))
        .select("id", F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)).alias("vector"))
    )
    kind = kept.schema["id"].dataType.simpleString()
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = kept.orderBy(draw, "vector").limit(k).collect()
    spark = table.sparkSession
    nothing = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], f"id {kind}, {nothing}").withColumnRenamed("id", id)

    at, before = np.array([r["vector"] for r in start], np.int64), None
    scratch, rows = Scratch(spark, "clusters"), kept
    sums, counts = np.zeros(at.shape, object), np.zeros(len(at), object)
    for r in range(rounds + 1):
        last, rows = rows, scratch.keep(_assigned(rows, kind, centres(at, before)))
        if r:
            scratch.drop(last)
        if r < rounds:
            more, n = _changes(rows, len(at), dims)
            sums, counts, before = sums + more, counts + n, at
            at = np.array([s // c if c else a for s, c, a in zip(sums, counts, at)]).astype(np.int64)

    measured = scratch.keep(_measured(rows, kind, at))
    scratch.drop(rows)
    each = measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    totals = {r["cluster"]: int(r["total"]) for r in each.collect()}
    table_ = [
        (j, n, sum(totals.values()), sha256(",".join(map(str, at[j])).encode()).hexdigest()) for j, n in totals.items()
    ]
    told = spark.createDataFrame(table_, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per centroid.
    return measured.join(F.broadcast(told), "cluster").select(
        F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
