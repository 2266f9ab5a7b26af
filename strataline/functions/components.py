"""Connected components by alternating large-star and small-star steps, each task's edges contracted to stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.functions.core import unsent
from strataline.functions.scratch import saved


TASK_EDGES = 250_000


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # large star: every larger neighbour of u now points to the least of u's neighbourhood
    large = edges.withColumnRenamed("v", "w").join(unsent(least.withColumnRenamed("u", "w")), "w").select("u", F.col("m").alias("v")).distinct()
    # small star: the smaller neighbours of u, and u, point to the least of them
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    linked = large.join(unsent(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return linked.union(low.select("u", F.col("m").alias("v"))).distinct()


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (u, v), and the least vertex that each reaches over these."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up, a, b = np.arange(len(ids)), at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up != (over := up[up])).any():
            up = over
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return ids, ids[up]


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) with u > v, of each task at most about `most` at a time, as stars: each vertex with the least it reaches over these."""

    def work(batches):
        held, n = [], 0

        def stars():
            ids, roots = _roots(*(np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1)))
            leaf = ids != roots
            return pa.RecordBatch.from_arrays([pa.array(x[leaf], f.type) for x, f in zip((ids, roots), held[0].schema)], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= most:
                yield stars()
                held, n = [], 0
        if held:
            yield stars()

    return edges.mapInArrow(work, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of edges (u, v); root is the least vertex reachable.

    Edges may come in either direction and repeat; loops and edges with a null end are ignored. A task contracts what it writes
    to stars, TASK_EDGES edges at a time; where that many or fewer are left, one such step settles all of them: a round takes six
    shuffles with a task for each of the session's partitions. More are settled by rounds, as are ids that are no whole numbers (runs
    of a mask are structs, in Spark's order). Every round is written to the shared folder, and the end is seen from a count and a sum
    of hashes: no step makes an edge's ends larger, so a round that changes nothing leaves stars alone. A star with a hot centre
    has one edge for each leaf, its least neighbour is found by partial aggregates, and its join may be split by the adaptive planner.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    whole = isinstance(ends.schema["u"].dataType, T.IntegralType)
    now = saved(_contracted(ends, TASK_EDGES) if whole else ends.distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0] > whole * TASK_EDGES:
        # a step makes hardly more edges than it gets; few of them need few files, whatever the session's partitions
        now = _stars(now).coalesce(max(1, before[0] // TASK_EDGES))
        now = saved(_contracted(now, TASK_EDGES) if whole else now, "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if whole:
            now = saved(_contracted(now.coalesce(1), TASK_EDGES + 1), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
