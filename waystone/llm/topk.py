"""Exact top-k inner products, pruned by segment statistics.

Vectors are cut into 1, 2, 4, ... segments. With mean m and deviation d of a segment of
n components, the squared distance of two segments is at least
n * ((m1 - m2)^2 + (d1 - d2)^2). As q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, a lower
bound of the distance is an upper bound of the score: pairs below the k-th best score
found so far are dropped, coarse levels first, and exact scores are computed for the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stage import stage

#: Queries that a pass over the table carries along; bounds what is sent to each task.
QUERY_BLOCK = 4096
#: Candidates and queries that are compared at a time inside a task.
ROWS, COLUMNS = 2048, 256
SCALE = 256


def segment_levels(width: int) -> list[int]:
    """Numbers of equal segments, coarse to fine."""
    out, n = [1], 2
    while width % n == 0 and width // n >= 2 and len(out) < 6:
        out.append(n)
        n *= 2
    return out


def statistics(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of ``n`` segments, scaled by the root of the segment's length."""
    parts = x.reshape(len(x), n, -1)
    scale = np.sqrt(parts.shape[2])
    return parts.mean(2) * scale, parts.std(2) * scale


class Block:
    """Vectors with their statistics at every level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: list[int]):
        self.ids, self.vectors = ids, vectors
        self.norms = (vectors * vectors).sum(1)
        self.levels = [statistics(vectors, n) for n in levels]


def upper_bounds(queries: Block, rows: Block, level: int, q: np.ndarray, r: np.ndarray):
    """Upper bounds of the scores of the pairs (q, r)."""
    (mq, dq), (mr, dr) = queries.levels[level], rows.levels[level]
    apart = ((mq[q] - mr[r]) ** 2).sum(1) + ((dq[q] - dr[r]) ** 2).sum(1)
    return (queries.norms[q] + rows.norms[r] - apart) / 2


def search(queries: Block, rows: Block, k: int, best_score: np.ndarray, best_id: np.ndarray):
    """Merge the rows into the k best (score, id) of every query; arrays (queries, k), worst last."""
    for start in range(0, len(queries.ids), COLUMNS):
        stop = min(start + COLUMNS, len(queries.ids))
        floor = best_score[start:stop, -1]
        # coarsest level for all pairs of the block at once
        mq, dq = (x[start:stop] for x in queries.levels[0])
        mr, dr = rows.levels[0]
        bound = (
            queries.norms[start:stop, None] + rows.norms[None]
            - (mq - mr.T) ** 2 - (dq - dr.T) ** 2
        ) / 2
        # slack for rounding; scores are whole numbers
        q, r = np.nonzero(bound >= floor[:, None] - 0.5)
        for level in range(1, len(queries.levels)):
            if not len(q):
                break
            keep = np.zeros(len(q), bool)
            for a in range(0, len(q), 1 << 16):
                part = slice(a, a + (1 << 16))
                limit = upper_bounds(queries, rows, level, q[part] + start, r[part])
                keep[part] = limit >= floor[q[part]] - 0.5
            q, r = q[keep], r[keep]
        if len(q) * 8 > bound.size:  # most pairs are left: one product of the blocks
            scores = (queries.vectors[start:stop] @ rows.vectors.T)[q, r]
        else:
            scores = np.einsum("ij,ij->i", queries.vectors[q + start], rows.vectors[r])
        found = rows.ids[r]
        other = found != queries.ids[q + start]
        merge(best_score, best_id, q[other] + start, scores[other], found[other], k)


def merge(best_score, best_id, q, scores, ids, k: int) -> None:
    """Put scored pairs into the arrays of the best; ties go to the smaller id."""
    if not len(q):
        return
    touched = np.unique(q)
    old = np.repeat(touched, k)
    all_q = np.concatenate([old, q])
    all_s = np.concatenate([best_score[touched].ravel(), scores])
    all_i = np.concatenate([best_id[touched].ravel(), ids])
    order = np.lexsort((all_i, -all_s, all_q))
    all_q, all_s, all_i = all_q[order], all_s[order], all_i[order]
    first = np.flatnonzero(np.concatenate([[True], all_q[1:] != all_q[:-1]]))
    place = np.arange(len(all_q)) - np.repeat(first, np.diff(np.append(first, len(all_q))))
    top = place < k
    best_score[all_q[top], place[top]] = all_s[top]
    best_id[all_q[top], place[top]] = all_i[top]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """Rows without nulls and non-finite components, as doubles."""
    bad = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    rows = vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    )
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole components floor(256 * x); their products are exact below 2^53."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(-1, width) * SCALE)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` best rows of ``vectors`` (vec_id, embedding) for every row whose id is
    divisible by ``every``, by inner product of floor(256 * x), itself left out.

    Returns query_id, rank, vec_id, score; ties go to the smaller id. Rows with a null id,
    a null vector or null or non-finite components take no part; vectors of another length
    than the query's are not compared; rows that repeat an id are candidates each, and one
    of them (the smallest vector) asks; an empty table gives an empty result. Queries go through the
    table in blocks of ``QUERY_BLOCK``, so a task holds a bounded number of them.
    """
    rows = stage(whole_vectors(vectors).withColumn("width", F.size("v")), "vectors")
    spark = rows.sparkSession
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id", "width").agg(
        F.min("v").alias("v")
    )
    one = Window.partitionBy("vec_id").orderBy("width", "v")
    asked = asked.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    counts = asked.groupBy("width").count().collect()  # one row for each length of vector
    schema = "query_id long, vec_id long, score double"
    parts = []
    for width, number in sorted((r["width"], r["count"]) for r in counts if r["width"] > 0):
        blocks = -(-number // QUERY_BLOCK)
        # hash ranges of about QUERY_BLOCK queries; a block is what one pass carries
        dealt = asked.filter(F.col("width") == width).withColumn(
            "_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        )
        dealt = stage(dealt.select("vec_id", "v", "_block"), "queries") if blocks > 1 else dealt
        for block in range(blocks):
            table = dealt.filter(F.col("_block") == block).select("vec_id", "v").toArrow()
            if not table.num_rows:
                continue
            sent = spark.sparkContext.broadcast(
                (table["vec_id"].to_numpy(), matrix(table["v"].combine_chunks(), width))
            )
            found = rows.filter(F.col("width") == width).select("vec_id", "v")
            parts.append(found.mapInArrow(_pass(sent, width, k), schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = union.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _pass(sent, width: int, k: int):
    def run(batches):
        ids, vectors = sent.value
        levels = segment_levels(width)
        queries = Block(ids, vectors, levels)
        score = np.full((len(ids), k), -np.inf)
        found = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            keys = batch.column("vec_id").to_numpy()
            values = matrix(batch.column("v"), width)
            for a in range(0, len(keys), ROWS):
                rows = Block(keys[a : a + ROWS], values[a : a + ROWS], levels)
                search(queries, rows, k, score, found)
        q, place = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[q]), pa.array(found[q, place]), pa.array(score[q, place])],
            names=["query_id", "vec_id", "score"],
        )

    return run
