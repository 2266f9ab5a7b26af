"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors cos >= c means a squared distance of at most 2 - 2c. Vectors are rotated to the principal axes of a sample
and the axes dealt into low-dimensional blocks; every block has a share of the squared distance in proportion to its share
of the sample's variance. If a pair is within the distance, it is within its budget in one block at least, so the pairs that are
in some block are all there can be; they are verified at once by their cosine on the original vectors.

The sample gives pivots; a vector is at home with its nearest. Homes are cut into chunks of bounded size by a hash, and a chunk
is one row of a written table, so that every vector lies there once. Pairs of chunks are a product of that table with itself whose tasks
read it, not a shuffle: copies of a vector for each chunk it meets would grow with the square of the table. What lies between
two vectors of homes p and q crosses the plane between p and q, so their distances to it add up to no more than theirs: chunks
whose nearest rows are too far apart by that do not meet, nor do the rows of those that do.
Tasks return sums of links and a forest of the pairs, never all pairs of a group. Equal vectors are one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.components import components
from strataline.llm.common import lean, parts_for, saved
from strataline.llm.simhash import Forest
from strataline.llm.vectors import common_length, matrix, sample_rows, usable

SLACK = 1e-6  # covers, for each axis of a block, the rounding to single precision, so that no pair is lost
TILE = 256, 2048  # rows compared at once
TASK_BYTES = 1 << 24  # vectors of either side of a product's task


class Blocks:
    """Rotation, budgets and pivots, from a bounded sample."""

    def __init__(self, sample: np.ndarray, cosine: float, width: int, pivots: int):
        u = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        values, axes = np.linalg.eigh(u.T @ u / len(u) - np.outer(u.mean(0), u.mean(0)))
        n = max(1, -(-u.shape[1] // width))
        order = np.argsort(-values, kind="stable")
        self.axes = [axes[:, order[b::n]] for b in range(n)]
        share = np.array([max(values[order[b::n]].sum(), 1e-6) for b in range(n)])
        self.budget = (2 - 2 * cosine) * share / share.sum() + SLACK * (width + 4)
        self.radius = float(np.sqrt(max(2 - 2 * cosine, 0.0))) + 1e-6
        step = max(1, len(u) // pivots)
        self.pivots = np.unique(u[::step][:pivots], axis=0)

    def homes(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.pivots.T).argmax(1)

    def gaps(self, unit: np.ndarray, home: int, others: np.ndarray) -> np.ndarray:
        """The distance of rows of a home to the planes between it and other pivots; 0 where those are too close to tell."""
        apart = self.pivots[home] - self.pivots[others]
        width = np.sqrt((apart**2).sum(1))
        return unit @ np.where(width[:, None] > 1e-6, apart / np.maximum(width, 1e-6)[:, None], 0.0).T

    def sides(self, unit: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows as either factor of a product that gives their squared distance in each block."""
        left, right = [], []
        for axes in self.axes:
            y = unit @ axes
            d, one = (y**2).sum(1, keepdims=True), np.ones((len(y), 1))
            left.append(np.hstack([-2 * y, d, one]).astype(np.float32))
            right.append(np.hstack([y, one, d]).astype(np.float32))
        return left, right


class _Chunk:
    """The rows of a chunk, ready to be compared."""

    def __init__(self, plan: Blocks, home: int, ids, n, x: np.ndarray):
        self.home, self.ids, self.n, self.x = home, ids, n, x.astype(np.float64)
        self.square = np.sqrt((self.x**2).sum(1))
        self.unit = self.x / np.linalg.norm(self.x, axis=1, keepdims=True)
        self.left, self.right = plan.sides(self.unit)


def _pairs(plan: Blocks, cosine: float, a: _Chunk, b: _Chunk):
    """Linked pairs (i in a, j in b) piece by piece; those of a chunk with itself once, i < j."""
    same, apart = a is b, a.home != b.home
    rows, others = np.arange(len(a.x)), np.arange(len(b.x))
    if apart:
        ga, gb = plan.gaps(a.unit, a.home, [b.home])[:, 0], plan.gaps(b.unit, b.home, [a.home])[:, 0]
        rows, others = np.argsort(ga, kind="stable"), np.argsort(gb, kind="stable")
        ga, gb = ga[rows], gb[others]
        rows = rows[: np.searchsorted(ga, plan.radius - gb[0], "right")]
        others = others[: np.searchsorted(gb, plan.radius - ga[0], "right")]
    left, right = [x[rows] for x in a.left], [np.ascontiguousarray(x[others].T) for x in b.right]
    for s in range(0, len(rows), TILE[0]):
        e = min(len(rows), s + TILE[0])
        most = int(np.searchsorted(gb[: len(others)], plan.radius - ga[s], "right")) if apart else len(others)
        for t in range(s if same else 0, most, TILE[1]):
            z = min(most, t + TILE[1])
            near = np.zeros((e - s, z - t), bool)
            for x, y, budget in zip(left, right, plan.budget):
                near |= x[s:e] @ y[:, t:z] <= np.float32(budget)
            at = np.flatnonzero(near)
            for c in range(0, len(at), 200_000):
                p, q = np.divmod(at[c : c + 200_000], z - t)
                p, q = rows[p + s], others[q + t]
                if same:
                    p, q = p[p < q], q[p < q]
                cos = (a.x[p] * b.x[q]).sum(1) / (a.square[p] * b.square[q])
                if (keep := cos >= cosine).any():
                    yield p[keep], q[keep]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, width: int = 16, sample: int = 2048, pivots: int | None = None, chunk: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding).

    Null, empty and zero vectors, those with null or non-finite components and those of another length than most link with
    nothing: no links, their own component. n_links counts rows, so repeated rows link with each other. Rows without vec_id take
    part and can link others; a component of such rows alone has no id and its rows are not kept. Other columns are ignored,
    whatever their names; a table without rows gives none. pivots: default by the number of different vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    length = common_length(rows, "embedding")
    good = rows.where(usable("embedding", length))
    alone = rows.where(~usable("embedding", length)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    entries = saved(good.groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("entry", F.monotonically_increasing_id()), "vectors")
    x = sample_rows(entries, "embedding", sample)
    if not len(x):
        return alone
    # more pivots, so smaller homes, the more vectors there are, up to an eighth of the sample
    total = entries.count()
    plan = Blocks(x, cosine, width, pivots or min(max(16, total >> 12), sample >> 3))
    element = dict(entries.dtypes)["embedding"][len("array<") : -1]
    stored = np.dtype("<f4" if element == "float" else "<f8")

    def settle(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(2))
                home = plan.homes(v / np.linalg.norm(v, axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *b.columns], names=["home", "entry", "n", "embedding"])

    settled = entries.select("entry", "n", "embedding").mapInArrow(settle, f"home int, entry long, n long, embedding array<{element}>")
    sizes = {r["home"]: -(-r["k"] // chunk) for r in settled.groupBy("home").agg(F.count("*").alias("k")).collect()}  # a row a pivot
    # rounding may give a row that lies between two pivots the other home the next time
    cut = F.coalesce(F.create_map(*[F.lit(y) for x in sizes.items() for y in x])[F.col("home")], F.lit(1))
    part = F.pmod(F.xxhash64("entry"), cut).cast("int")

    def pack(batches):
        key, held = None, []

        def row():
            ids, n, v = (np.concatenate(y) for y in zip(*held))
            gap = plan.gaps(v / np.linalg.norm(v, axis=1, keepdims=True), key[0], np.arange(len(plan.pivots)))
            values = [[key[0]], [key[1]], [ids.astype("<i8").tobytes()], [n.astype("<i8").tobytes()], [v.astype(stored).tobytes()], [gap.min(0).tolist()]]
            return pa.RecordBatch.from_arrays([pa.array(y, t) for y, t in zip(values, types)], names=["home", "part", "ids", "n", "vectors", "gaps"])

        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
        for b in batches:
            if not b.num_rows:
                continue
            home, no, ids, n = (b.column(c).to_numpy() for c in range(4))
            v = matrix(b.column(4))
            cuts = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (no[1:] != no[:-1]), [True]]))
            for i, j in zip(cuts, cuts[1:]):
                if key != (home[i], no[i]):
                    if held:
                        yield row()
                    key, held = (home[i], no[i]), []
                held.append((ids[i:j], n[i:j], v[i:j]))
        if held:
            yield row()

    n_chunks = sum(sizes.values())
    dealt = settled.withColumn("part", part).select("home", "part", "entry", "n", "embedding").repartition(parts_for(spark, n_chunks, 4), "home", "part").sortWithinPartitions("home", "part")
    chunks = saved(dealt.mapInArrow(lean(pack), "home int, part int, ids binary, n binary, vectors binary, gaps array<double>"), "chunks")
    # few tasks for few rows: a product has a task for each two partitions
    chunks = chunks.withColumn("no", F.col("home") * max(sizes.values()) + F.col("part")).coalesce(max(8, total * length * stored.itemsize // TASK_BYTES))
    a, b = (chunks.select(*[F.col(c).alias(f"{c}_{s}") for c in chunks.columns]) for s in "ab")
    # two chunks meet once, which way goes by parity
    once = (F.col("no_a") == F.col("no_b")) | F.when((F.col("no_a") + F.col("no_b")) % 2 == 0, F.col("no_a") < F.col("no_b")).otherwise(F.col("no_a") > F.col("no_b"))
    near = F.col("gaps_a")[F.col("home_b")] + F.col("gaps_b")[F.col("home_a")] <= plan.radius
    met = a.hint("shuffle_replicate_nl").join(b, once & near).select(*[f"{c}_{s}" for s in "ab" for c in ("no", "home", "ids", "n", "vectors")])

    def join(batches):
        sums: dict[int, int] = {}
        seen: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        last: dict[int, tuple[int, _Chunk]] = {}

        def side(b, k, c):
            no = b.column(c)[k].as_py()
            if c not in last or last[c][0] != no:
                ids, n = (np.frombuffer(b.column(c + d)[k].as_buffer(), "<i8") for d in (2, 3))
                last[c] = no, _Chunk(plan, b.column(c + 1)[k].as_py(), ids, n, np.frombuffer(b.column(c + 4)[k].as_buffer(), stored).reshape(len(ids), -1))
            return last[c]

        def add(ids, n):
            for e, s in zip(ids[n > 0].tolist(), n[n > 0].tolist()):
                sums[e] = sums.get(e, 0) + int(s)

        def root(e):
            while (up := seen.get(e, e)) != e:
                seen[e] = seen.get(up, up)
                e = up
            return e

        for b in batches:
            for k in range(b.num_rows):
                (i, x), (j, y) = side(b, k, 0), side(b, k, 5)
                if i == j:
                    y = x
                links = np.zeros(len(x.ids)), np.zeros(len(y.ids))
                both = x.ids if i == j else np.concatenate([x.ids, y.ids])
                forest = Forest(len(both))
                for p, q in _pairs(plan, cosine, x, y):
                    links[0][:] += np.bincount(p, y.n[q], len(x.ids))
                    links[1][:] += np.bincount(q, x.n[p], len(y.ids))
                    forest.join(p, q + (0 if i == j else len(x.ids)))
                add(x.ids, links[0])
                add(y.ids, links[1])
                for p, q in forest.kept:
                    e, f = root(int(both[p])), root(int(both[q]))
                    if e != f:
                        seen[max(e, f)] = min(e, f)
                        edges.append((int(both[p]), int(both[q])))
        yield pa.RecordBatch.from_pydict({"a": pa.array([*sums, *(e for e, _ in edges)], pa.int64()), "b": pa.array([*(-s for s in sums.values()), *(f for _, f in edges)], pa.int64()), "link": pa.array([False] * len(sums) + [True] * len(edges))})

    found = saved(met.mapInArrow(lean(join), "a long, b long, link boolean"), "links")
    links = found.where("not link").groupBy("a").agg(F.sum(-F.col("b")).alias("links"))
    roots = components(found.where("link").select(F.col("a").alias("u"), F.col("b").alias("v")))
    # vectors stay out of these joins: a vector of one row is that row, only those of several are looked up
    rooted = entries.select("entry", "n", "least").join(roots.withColumnRenamed("id", "entry"), "entry", "left").join(links.withColumnRenamed("a", "entry"), "entry", "left").select("entry", "n", "least", F.coalesce("root", "entry").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    named = saved(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("entry", "n", F.col("least").alias("vec_id"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    several = entries.where("n > 1").select("entry", "embedding").join(named.select("entry", "n_links", "component_id"), "entry").drop("entry")
    made = named.where("n = 1").select("vec_id", "n_links", "component_id")
    if not several.isEmpty():
        made = made.union(good.join(several, "embedding").select("vec_id", "n_links", "component_id"))
    return made.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).union(alone)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
