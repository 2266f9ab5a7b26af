"""Centroid clustering by Lloyd rounds over two trees.

Vectors stay where they are: each task packs its rows in chunks and builds a cover tree over the distinct vectors of a
chunk, once. In each round a task also builds a tree over the centroids and walks both at once. A pair of nodes is dropped
if the least distance that its vectors and centroids can have is above the most that the vector node has to its nearest centroid
by any pair seen; what is left are pairs of a vector and a centroid, compared exactly in whole numbers. A round sends one
row of sums for each task and centroid; k x dimensions sums come to the driver, whatever the number of vectors.

Cover tree: the children of a node with radius r are centres more than r/2 apart from each other, each with what lies within r/2 of it.
A node's radius is the largest distance that is really there, so bounds are as tight as the centres allow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import lean, saved, table

MOST = 1 << 27  # of a component's absolute value: squared distances of 64 components then fit a long
SLACK = 1e-9  # covers the rounding of distances in double precision, relative to the numbers compared


class CoverTree:
    """Nodes in arrays: centre (a row of the points), radius, first and number of children; a leaf has none and holds one point."""

    def __init__(self, points: np.ndarray):
        x = points.astype(np.float64)
        center, radius, first, count = [0] if len(x) else [], [0.0], [0], [0]
        todo = [(0, np.arange(len(x)))] if len(x) else []
        while todo:
            node, rows = todo.pop()
            apart = np.sqrt(((x[rows] - x[center[node]]) ** 2).sum(1))
            radius[node] = float(apart.max()) * (1 + SLACK)
            if len(rows) == 1:
                continue
            half, groups = radius[node] / 2, []
            rows = rows[np.argsort(apart, kind="stable")]  # the centre comes first and is a child of itself
            y = x[rows] - x[center[node]]  # small numbers, so that products are as exact as the radius needs
            norms = (y**2).sum(1)
            left = np.arange(len(rows))
            if radius[node] == 0:  # equal ones, each a leaf
                groups, left = list(rows.reshape(-1, 1)), left[:0]
            while len(left):
                d2 = norms[left] + norms[left[0]] - 2 * (y[left] @ y[left[0]])
                near = d2 <= half * half
                near[0] = True
                groups.append(rows[left[near]])
                left = left[~near]
            first[node], count[node] = len(center), len(groups)
            for g in groups:
                todo.append((len(center), g))
                center.append(int(g[0]))
                radius.append(0.0), first.append(0), count.append(0)
        self.center, self.radius = np.array(center, np.int32), np.array(radius[: len(center)])
        self.first, self.count = np.array(first[: len(center)], np.int32), np.array(count[: len(center)], np.int32)

    @classmethod
    def of(cls, center: np.ndarray, radius: np.ndarray, first: np.ndarray, count: np.ndarray) -> CoverTree:
        tree = cls.__new__(cls)
        tree.center, tree.radius, tree.first, tree.count = center, radius, first, count
        return tree

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes, and the place in nodes of the parent of each."""
        n = self.count[nodes]
        parent = np.repeat(np.arange(len(nodes)), n)
        return np.repeat(self.first[nodes], n) + np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n), parent


def nearest(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, over: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """For each of distinct points (i8) the number of its nearest centroid, the smallest of equals, and the squared distance."""
    x, c = points.astype(np.float64), centroids.astype(np.float64)
    xx, cc = (x**2).sum(1), (c**2).sum(1)
    bound = np.full(len(tree.center), np.inf)  # a centroid is at most so far from every vector of the node
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        i, j = tree.center[a], over.center[b]
        if len(a) < 4096:
            d2 = ((x[i] - c[j]) ** 2).sum(1)
            wide = 0.0
        else:
            d2 = xx[i] + cc[j] - 2 * np.einsum("ij,ij->i", x[i], c[j])
            wide = 1e-13 * (xx[i] + cc[j])
        low, high = np.sqrt(np.maximum(d2 - wide, 0)), np.sqrt(np.maximum(d2, 0) + wide)
        reach = tree.radius[a] + over.radius[b]
        np.minimum.at(bound, a, (high + reach) * (1 + SLACK))
        keep = (low - reach) * (1 - SLACK) <= bound[a]
        a, b = a[keep], b[keep]
        done = (tree.count[a] == 0) & (over.count[b] == 0)
        ends.append((a[done], b[done]))
        a, b = a[~done], b[~done]
        # the node of the larger radius is opened
        open_b = (over.count[b] > 0) & ((tree.count[a] == 0) | (over.radius[b] > tree.radius[a]))
        kids_b, parent_b = over.children(b[open_b])
        kids_a, parent_a = tree.children(a[~open_b])
        bound[kids_a] = np.minimum(bound[kids_a], bound[a[~open_b]][parent_a])
        a, b = np.concatenate([a[open_b][parent_b], kids_a]), np.concatenate([kids_b, b[~open_b][parent_a]])
    cluster, distance = np.full(len(points), len(centroids)), np.full(len(points), np.iinfo(np.int64).max)
    for a, b in ends:
        for at in range(0, len(a), 1 << 16):
            i, j = tree.center[a[at : at + (1 << 16)]], over.center[b[at : at + (1 << 16)]]
            d = ((points[i] - centroids[j]) ** 2).sum(1)
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            best = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            i, j, d = i[best], j[best], d[best]
            better = (d < distance[i]) | (d == distance[i]) & (j < cluster[i])
            cluster[i[better]], distance[i[better]] = j[better], d[better]
    return cluster, distance


CHUNKS = "ids array<long>, inverse binary, points binary, center binary, radius binary, first binary, count binary"


def _chunks(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """Chunks of vectors (vec_id, v) with the tree of each; no shuffle."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def pack(ids: list, parts: list[np.ndarray]):
        points, inverse = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        t = CoverTree(points)
        arrays = [inverse.ravel().astype("<i4"), points.astype("<i4"), t.center, t.radius, t.first, t.count]
        kinds = [pa.list_(pa.int64()), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([ids, *(y.tobytes() for y in arrays)], kinds)], names=names)

    def work(batches):
        ids, parts = [], []
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            own = b.column(0).to_pylist()
            at = 0
            while at < len(own):
                take = min(len(own), at + rows - len(ids))
                ids += own[at:take]
                parts.append(flat[at:take])
                at = take
                if len(ids) == rows:
                    yield pack(ids, parts)
                    ids, parts = [], []
        if ids:
            yield pack(ids, parts)

    return vectors.mapInArrow(lean(work), CHUNKS)


def _opened(batch, dim: int):
    """(ids, place of each row's vector, vectors, tree) of each chunk of a batch."""
    for r in range(batch.num_rows):
        inverse, points, *nodes = (batch.column(k)[r].as_buffer() for k in range(1, 7))
        tree = CoverTree.of(*(np.frombuffer(n, d) for n, d in zip(nodes, ("<i4", "<f8", "<i4", "<i4"))))
        yield batch.column(0)[r].values, np.frombuffer(inverse, "<i4"), np.frombuffer(points, "<i4").reshape(-1, dim).astype(np.int64), tree


def _sums(chunks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and sums of the vectors of each centroid that has any."""
    k, dim = centroids.shape

    def work(batches):
        over = CoverTree(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for _, inverse, points, tree in _opened(b, dim):
                cluster, _ = nearest(points, tree, centroids, over)
                n = np.bincount(inverse, minlength=len(points))
                np.add.at(counts, cluster, n)
                np.add.at(sums, cluster, points * n[:, None])
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has]), pa.array(sums[has].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    # sums over all vectors of a cluster may need more than a long
    each = chunks.mapInArrow(lean(work), "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("d", "x"))
    rows = each.groupBy("cluster", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["cluster"], (r["n"], [0] * dim))[1][r["d"]] = int(r["x"])
    return out


def whole_vectors(df: DataFrame, column: str, dim: int, scale: int) -> DataFrame:
    """vec_id and v (ints: floor(scale * x)) of the rows whose vector has exactly dim components, none null or non-finite."""
    x = F.col(column)
    right = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), c.cast("double") * scale))).cast("int"))))
    return df.where(F.coalesce(right, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def lloyd(df: DataFrame, k: int = 40, rounds: int = 5, column: str = "embedding", dim: int = 64, scale: int = 256, seed: str = "2:", chunk: int = 1024) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of every row of df (vec_id, column) whose vector takes part; and the final centroids.

    Vectors with exactly dim components, none null or non-finite, take part, as whole numbers floor(scale * x), held within
    +-2^27 so that distances fit a long; zero vectors do too. Centroids start as the k vectors with the least sha256 of seed and
    vec_id (rows without vec_id are assigned but don't start one; equal ids are told apart by their components; fewer vectors start
    fewer centroids, and equal ones stay apart). In each round every vector goes to its nearest centroid, the smaller number of
    equals, and each centroid that has vectors becomes the floor of their mean. Repeated rows count each; other columns are
    ignored, whatever their names; a table without vectors gives no rows and no centroids.
    """
    vectors = whole_vectors(df, column, dim, scale)
    start = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    spark = df.sparkSession
    if not start:  # rows without vec_id alone start none
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = np.array([r["v"] for r in start], np.int64)
    chunks = saved(_chunks(vectors, dim, chunk), "chunks")
    for _ in range(rounds):
        before, centroids = centroids, centroids.copy()
        for c, (n, sums) in _sums(chunks, before).items():
            centroids[c] = [s // n for s in sums]
        if (before == centroids).all():
            break  # nothing would change any more

    def work(batches):
        over = CoverTree(centroids)
        for b in batches:
            for ids, inverse, points, tree in _opened(b, dim):
                cluster, distance = nearest(points, tree, centroids, over)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster[inverse].astype(np.int32)), pa.array(distance[inverse])], names=["vec_id", "cluster", "distance"])

    return chunks.mapInArrow(lean(work), "vec_id long, cluster int, distance long"), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned and its clusters' summed distances, the sum over all, and the hash of each final centroid."""
    from hashlib import sha256

    spark = assigned.sparkSession
    kind = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid_sha256", T.StringType())])
    hashes = spark.createDataFrame([(c, sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)], kind)
    assigned = saved(assigned, "assigned")
    sums = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row a centroid
    total, held = sum(map(int, sums.values())), lambda x: min(int(x), 2**63 - 1)
    each = spark.createDataFrame([(c, held(s), held(total)) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long").join(hashes, "cluster")
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*lloyd(table(spark, sf_dir, "embeddings")))


def lloyd_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The same by all distances."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k})"]
    for i in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(v.v, c.m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, c.c, CAST({d} AS BIGINT) AS d FROM v CROSS JOIN c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT a.c, unnest(range({dim})) AS i, unnest(v.v) AS x FROM a{i} a JOIN v ON v.r = a.r)")
            steps.append(f"w{i} AS (SELECT c, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS m FROM (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM u{i} GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(w.m, o.m) AS m FROM c{i} o LEFT JOIN w{i} w ON w.c = o.c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c"""
