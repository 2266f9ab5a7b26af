"""Nearest neighbours by learned partitions.

Fit (driver, on at most `sample` different vectors, a documented bound): the neighbour graph of the sample is cut into balanced
parts by recursive bisection along its slowest-mixing vector, with swaps that lessen the cut; a small softmax classifier
learns to tell a vector's part. The number of parts a query visits is the least with which held-out vectors of the sample
find `recall` of their true neighbours. There are more parts the more rows there are, as many as the sample can teach.
Index: every row goes to its most probable part. Parts are split into chunks of about `chunk` rows by a hash of vec_id, so
no task holds more, whatever a part's share of rows. Search: each query visits all chunks of its most probable parts and is
ranked there by exact inner products; the best of all chunks are merged. Below 4 * parts sampled vectors there is one part, and
the search is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm.common import parts_for, saved
from strataline.llm.vectors import common_length, matrix, sample_rows, usable


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest inner products of each row among the others, by position."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return np.argpartition(-s, min(k, len(x) - 2), axis=1)[:, :k]


def bisect(adjacency: np.ndarray, members: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few edges between them."""
    a = adjacency[np.ix_(members, members)].astype(np.float64)
    degree = np.sqrt(a.sum(1) + 1e-9)
    v = rng.standard_normal(len(members))
    first = degree / np.linalg.norm(degree)
    for _ in range(rounds):  # power iteration on the lazy walk, without its constant vector
        v = (v + (a @ (v / degree)) / degree) / 2
        v -= first * (first @ v)
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(len(members), bool)
    side[np.argsort(v / degree, kind="stable")[len(members) // 2 :]] = True
    for _ in range(20):  # swaps keep the balance
        gain = a @ np.where(side, 1.0, -1.0) * np.where(side, -1, 1)  # edges to the other side less those to its own
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right), max(1, len(members) // 50))
        both = (gain[left[:n]] + gain[right[:n]]) > 2 * a[left[:n], right[:n]]
        if not both.any():
            break
        side[left[:n][both]], side[right[:n][both]] = True, False
    return members[~side], members[side]


def balanced_parts(x: np.ndarray, parts: int, k: int, seed: int) -> np.ndarray:
    """Part of each row; sizes differ by one for each halving at most."""
    graph = np.zeros((len(x), len(x)), np.float32)
    near = neighbour_graph(x, k)
    graph[np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()] = 1
    graph = np.maximum(graph, graph.T)
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups = [h for g in groups for h in bisect(graph, g, rng)]
    out = np.zeros(len(x), np.int64)
    for p, g in enumerate(groups):
        out[g] = p
    return out


class Router:
    """Softmax over the parts, on the direction of a vector."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, rounds: int = 300, rate: float = 2.0, decay: float = 1e-5):
        x = self.features(x)
        self.w = np.zeros((x.shape[1], parts))
        goal = np.eye(parts)[part]
        speed = np.zeros_like(self.w)
        for _ in range(rounds):
            p = self._softmax(x @ self.w)
            speed = 0.9 * speed - rate * (x.T @ (p - goal) / len(x) + decay * self.w)
            self.w += speed

    @staticmethod
    def features(x: np.ndarray) -> np.ndarray:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([u * np.sqrt(x.shape[1]), np.ones((len(x), 1))])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self.features(x) @ self.w)


def fit(x: np.ndarray, parts: int = 16, k: int = 10, top: int = 20, recall: float = 0.97, seed: int = 7) -> tuple[Router | None, int]:
    """The router and how many parts a query visits."""
    if len(x) < 4 * parts:
        return None, 1
    held = np.arange(len(x)) % 8 == 0
    base = x[~held]
    router = Router(base, balanced_parts(base, parts, k, seed), parts)
    at = router.probabilities(base).argmax(1)
    s = x[held] @ base.T
    true = np.argpartition(-s, min(top, len(base) - 1), axis=1)[:, :top]
    order = np.argsort(-router.probabilities(x[held]), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)  # of each part for each query
    needed = np.take_along_axis(rank, at[true], axis=1)
    for visits in range(1, parts):
        if (needed < visits).mean() >= recall:
            return router, visits
    return router, parts


def _best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Positions in x and scores of each query's k best: larger score, then smaller id; its own id takes no part."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    kth = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if k < len(x) else np.full(len(q), -np.inf)
    slack = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(kth), kth, 0)))
    out = []
    for i in range(len(q)):
        c = np.flatnonzero((s[i] >= kth[i] - slack[i]) & (s[i] > -np.inf))
        exact = (q[i] * x[c]).sum(1)  # in one fixed order, so equal vectors have equal scores
        best = np.lexsort((ids[c], -exact))[:k]
        out.append((c[best], exact[best]))
    return out


def parts_of(rows: int, sample: int, least: int = 16, part_rows: int = 16_384) -> int:
    """A power of two: about a part for each part_rows rows, at least 32 sampled vectors in each."""
    want = min(rows // part_rows, sample // 32)
    return max(least, 1 << want.bit_length() - 1) if want else least


def search(base: DataFrame, queries: DataFrame, k: int = 20, sample: int = 4096, parts: int | None = None, recall: float = 0.95, chunk: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of base with the largest inner products for each query.

    base and queries: vec_id, embedding; other columns are ignored, whatever their names. Vectors that are null, empty, zero or
    hold null or non-finite components, those of another length than most of base, and rows without vec_id take no part. Rows
    with the query's vec_id are no candidates. Ties: smaller vec_id. Queries that repeat are answered once (of different
    vectors under one id, the one with the least hash); repeated candidates are each ranked. Without usable rows on
    either side there is no answer. parts: default by the number of rows.
    """
    spark = base.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    length = common_length(base, "embedding")
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable("embedding", length))
    base = clean(base)
    queries = clean(queries).groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("embedding").alias("h"), "embedding")).alias("q")).select("vec_id", "q.embedding")
    x = sample_rows(base, "embedding", sample)
    if not len(x):
        return spark.createDataFrame([], schema)
    router, visits = fit(x, parts or parts_of(base.count(), len(x)), top=k, recall=recall)

    def assign(n):
        def work(batches):
            for b in batches:
                v = matrix(b.column(1))
                if router is None:
                    where = np.zeros((len(v), 1), np.int64)
                elif len(v):
                    where = np.argsort(-router.probabilities(v), axis=1, kind="stable")[:, :n]
                else:
                    continue
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where.tolist(), pa.list_(pa.int32()))], names=["vec_id", "embedding", "parts"])

        return work

    typed = "vec_id long, embedding array<{}>, parts array<int>".format(dict(base.dtypes)["embedding"][6:-1])
    index = saved(base.mapInArrow(assign(1), typed).select("vec_id", "embedding", F.col("parts")[0].alias("part")), "index")
    sizes = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    chunks = F.create_map(*[F.lit(y) for p, n in sizes.items() for y in (p, -(-n // chunk))])
    rows = index.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks[F.col("part")]).cast("int")).withColumn("asks", F.lit(False))
    asked = queries.mapInArrow(assign(visits), typed).select("vec_id", "embedding", F.explode("parts").alias("part"))
    asked = asked.where(chunks[F.col("part")].isNotNull()).withColumn("chunk", F.explode(F.sequence(F.lit(0), (chunks[F.col("part")] - 1).cast("int")))).withColumn("asks", F.lit(True))

    def rank(batches):
        key, own_x, own_ids, x, ids = None, [], [], None, None
        for b in batches:
            if not b.num_rows:
                continue
            part, no, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "chunk", "asks"))
            v, vec = matrix(b.column(1)), b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (no[1:] != no[:-1]) | (asks[1:] != asks[:-1]), [True]]))
            for i, j in zip(edges, edges[1:]):
                if (part[i], no[i]) != key:
                    key, own_x, own_ids, x = (part[i], no[i]), [], [], None
                if not asks[i]:
                    own_x.append(v[i:j])
                    own_ids.append(vec[i:j])
                    continue
                if x is None:
                    x, ids = (np.concatenate(own_x), np.concatenate(own_ids)) if own_x else (np.zeros((0, 0)), vec[:0])
                for a in range(i, j, 512) if len(x) else ():
                    z = min(j, a + 512)
                    found = _best(v[a:z], vec[a:z], x, ids, k)
                    n = [len(c) for c, _ in found]
                    yield pa.RecordBatch.from_pydict({"query_id": np.repeat(vec[a:z], n), "vec_id": np.concatenate([ids[c] for c, _ in found]), "score": np.concatenate([s for _, s in found])})

    n = parts_for(spark, sum(-(-m // chunk) for m in sizes.values()), 1)
    near = rows.unionByName(asked.select(rows.columns)).repartition(n, "part", "chunk").sortWithinPartitions("part", "chunk", "asks").mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm.common import table

    base = table(spark, sf_dir, "embeddings")
    return search(base, base.where(F.col("vec_id") % 20 == 0))
