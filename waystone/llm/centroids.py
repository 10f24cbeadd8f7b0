"""Centroid clustering on whole numbers, with dot products that are kept up to date.

Every vector keeps its exact dot product with every centroid. A round changes centroids, so
it adds (new - old) * component to a product for the components that changed, and nothing
for centroids that stayed. As |v - c|^2 = |v|^2 - 2 v.c + |c|^2, the nearest centroid follows
from the products alone. Centroids (k times width numbers) are all that the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import remove, stage
from ..session import scratch_path

#: Components must be smaller than this after scaling, so that distances fit 64 bits.
LARGEST = 1 << 26
#: Whole numbers below it are exact as doubles.
EXACT = 1 << 53

STATE = "vec_id long, v array<int>, dots array<long>, cluster int, distance long"
RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
    "centroid_sha256 string"
)


def whole_vectors(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """Vectors of ``width`` finite components as whole numbers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select("vec_id", x.alias("v")).filter((F.size("embedding") == width) & ~odd)

    def run(batches):
        for batch in batches:
            flat = np.floor(pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False) * scale)
            if len(flat) and np.abs(flat).max() >= LARGEST:
                raise ValueError(f"a component times {scale} is not below {LARGEST}")
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()), lists(flat.astype(np.int32), width)],
                names=["vec_id", "v"],
            )

    return rows.mapInArrow(run, "vec_id long, v array<int>")


def lists(flat: np.ndarray, width: int) -> pa.ListArray:
    ends = np.arange(0, len(flat) + 1, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` rows with the smallest sha256 of ``<seed>:<vec_id>``; ties by components, rows
    without an id last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in best], np.int64)


def updated(v: np.ndarray, dots: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Bring dots (k, n) of the vectors v (width, n) from the old centroids to the new ones."""
    change = new - old
    for c in np.flatnonzero(change.any(1)):
        at = np.flatnonzero(change[c])
        step, part = change[c, at], v if len(at) == len(v) else v[at]
        largest = int(np.abs(step).max()) * int(np.abs(part).max(initial=0)) * len(at)
        if largest < EXACT:  # every partial sum is exact as a double
            dots[c] += (step.astype(np.float64) @ part.astype(np.float64)).astype(np.int64)
        else:
            dots[c] += step @ part


def assign(rows: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """Vectors with their products for ``old`` -> the same for ``new``, with the nearest centroid
    (ties: the smaller number) and the squared distance."""
    k, width = new.shape

    def run(batches):
        norms = (new * new).sum(1)
        for batch in batches:
            n = batch.num_rows
            flat = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False)
            v = np.ascontiguousarray(flat.reshape(n, width).T.astype(np.int64))
            if "dots" in batch.schema.names:
                flat_dots = pc.list_flatten(batch.column("dots")).to_numpy(zero_copy_only=False)
                dots = np.array(flat_dots.reshape(n, k).T, order="C")  # a copy to write to
            else:
                dots = np.zeros((k, n), np.int64)
            updated(v, dots, old, new)
            apart = norms[:, None] - 2 * dots
            nearest = apart.argmin(0)
            distance = apart[nearest, np.arange(n)] + (v * v).sum(0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("v"), lists(dots.T.ravel(), k),
                    pa.array(nearest.astype(np.int32)), pa.array(distance),
                ],
                names=["vec_id", "v", "dots", "cluster", "distance"],
            )

    return rows.mapInArrow(run, STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their vectors' mean; those without vectors stay."""
    width = centroids.shape[1]
    component: list[Column] = [F.sum(F.get("v", F.lit(j))).alias(f"s{j}") for j in range(width)]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *component).collect():
        out[row["cluster"]] = [row[f"s{j}"] // row["n"] for j in range(width)]
    return out


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2"
) -> DataFrame:
    """Lloyd's rounds over ``vectors`` (vec_id, embedding), each vector by its floor(scale * x).

    Returns vec_id, cluster, distance (squared, to the final centroid), cluster_inertia,
    inertia, centroid_sha256, a row per vector. Vectors of another width or with null or
    non-finite components take no part; rows that repeat an id count each; rows without an id
    are first centroids only where others are too few. With fewer vectors than ``k`` there are
    fewer centroids. Other columns are ignored; an empty table gives an empty result. A
    component of ``LARGEST`` or more after scaling is an error. Rounds stop early when no
    centroid moves, which changes nothing.
    """
    spark = vectors.sparkSession
    points = stage(whole_vectors(vectors, width, scale), "points")
    new = first_centroids(points, k, seed)
    if not len(new):
        return spark.createDataFrame([], RESULT)
    old, rows, before = np.zeros_like(new), points, None
    for turn in range(rounds + 1):
        path = scratch_path(spark, "round")
        assign(rows, old, new).write.parquet(path)
        rows = spark.read.schema(STATE).parquet(path)
        if before:  # only this round read it
            remove(spark, before)
        before = path
        if turn == rounds:
            break
        old, new = new, moved(rows, new)
        if (old == new).all():
            break
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    of_cluster = spark.createDataFrame(  # at most k rows
        [
            (c, s, total, hashlib.sha256(",".join(map(str, new[c].tolist())).encode()).hexdigest())
            for c, s in sorted(sums.items())
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    found = rows.select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster")
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
