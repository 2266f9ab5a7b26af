"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most 3 differing bits share at least 5 of their 8 positional bytes. A posting list of one
positional byte holds 1/256 of all fingerprints, so lists are intersected three at a time before pairs are tallied: of any 5
shared positions at least 3 lie in the lower or at least 3 in the upper half, so the 8 triples within the halves miss no
pair. Within a posting list of (triple, its 24 bits) the shared positional bytes of each pair are tallied, pairs below 5
are dropped, and the rest are verified by their differing bits. Equal fingerprints are one entry. A list above `hot` is
dealt out to many tasks first: it is intersected with every pair of the other positions, at least 2 of which must agree too.
Within a task lists above `large` are intersected with further positions in the same way. Of verified pairs only
those are emitted that join two sets not yet joined in the task, so a group of copies gives a forest, not all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.components import components
from strataline.llm.common import lean, parts_for, saved, text_slices

SEED, MAX_BITS, POSITIONS = 42, 3, 8
LEAST = POSITIONS - MAX_BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprints_of(texts: list[str | None], shingle: int = 3, step: int = 1 << 18) -> np.ndarray:
    """Fingerprints (u64) of whole texts; bit counts are added up `step` shingles at a time."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts = np.zeros((len(texts), 64), np.int64)
    n = np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[tuple[int, int]] = []  # document, number of its hashes in held

    def add():
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
            sizes = np.array([k for _, k in owners])
            np.add.at(counts, [d for d, _ in owners], np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
        held.clear(), owners.clear()

    for d, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        if len(words) < shingle:
            hashes = [digest(b" ".join(words), SEED)]
        else:
            hashes = [digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))] if shingle != 3 else [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
        n[d] = len(hashes)
        at = 0
        while at < len(hashes):
            take = hashes[at : at + step - len(held)]
            held += take
            owners.append((d, len(take)))
            at += len(take)
            if len(held) >= step:
                add()
    add()
    return np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row, without a shuffle."""

    def work(batches):
        for b in batches:
            for i, j, texts in text_slices(b, 1):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(fingerprints_of(texts, shingle).view("<i8"))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), "doc_id long, fp long")


class Forest:
    """Union-find over positions; joins pairs given as arrays and keeps those that joined something."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray):
        roots = []
        for x in (a, b):
            r = self.up[x]
            while (r != (q := self.up[r])).any():
                r = q
            self.up[x] = r
            roots.append(r)
        apart = roots[0] != roots[1]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.kept.append((x, y))
            self.up[x] = self.up[y] = min(r, s)


def _tally(fp: np.ndarray, at: np.ndarray, key: np.ndarray, forest: Forest, large: int, split):
    """Pairs of entries with equal keys: tally, filter, verify, join. at: positions in fp; split handles larger lists."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edge)
    if split is not None:
        for g in np.flatnonzero(sizes > large):
            split(at[edge[g] : edge[g + 1]])
        use = np.repeat((sizes > 1) & (sizes <= large), sizes)
    else:
        use = np.repeat(sizes > 1, sizes)
    at, key = at[use], key[use]
    d = 1
    here = np.arange(len(at))
    while True:
        here = here[here + d < len(at)]
        here = here[key[here] == key[here + d]]
        if not len(here):
            return
        a, b = at[here], at[here + d]
        x = fp[a] ^ fp[b]
        near = (x.view("u1").reshape(-1, POSITIONS) == 0).sum(1) >= LEAST
        near[near] = np.bitwise_count(x[near]) <= MAX_BITS
        forest.join(a[near], b[near])
        d += 1


def forest_of(keys: np.ndarray, fps: np.ndarray, large: int = 2048) -> list[tuple[int, int]]:
    """Pairs of fingerprints (u64) that join near ones among the entries of whole posting lists."""
    fp, at = np.unique(fps, return_inverse=True)
    forest = Forest(len(fp))

    def split(members: np.ndarray):
        shared = fp[members]
        parts = shared.view("u1").reshape(-1, POSITIONS).astype(np.int64)
        free = [p for p in range(POSITIONS) if (parts[:, p] != parts[0, p]).any()]
        # the positions where all agree aside, at most 3 of the free ones may differ
        for own in combinations(free, max(0, len(free) - MAX_BITS)):
            key = np.zeros(len(members), np.int64)
            for p in own:
                key = key << 8 | parts[:, p]
            _tally(fp, members, key, forest, large, None)

    _tally(fp, at.astype(np.int64), keys, forest, large, split)
    return [(int(fp[a].astype("<i8")), int(fp[b].astype("<i8"))) for a, b in forest.kept]


def _refined(posting: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings of a triple with each pair of the other positions: hashes of (posting, pair, its bytes), and the fingerprints."""
    bytes_of = fps.view("u1").reshape(-1, POSITIONS).astype(np.uint64)
    triple = posting >> 24
    keys, own = [], []
    for k, t in enumerate(TRIPLES):
        at = np.flatnonzero(triple == k)
        for n, (a, b) in enumerate(combinations([p for p in range(POSITIONS) if p not in t], LEAST - 3)):
            x = posting[at].astype(np.uint64) << np.uint64(32) | np.uint64(n << 16) | bytes_of[at, a] << np.uint64(8) | bytes_of[at, b]
            keys.append((x * np.uint64(0x9E3779B97F4A7C15) ^ x >> np.uint64(31)).view("<i8"))
            own.append(fps[at])
    return np.concatenate(keys), np.concatenate(own)


def near_links(fps: DataFrame, part_rows: int = 600_000, hot: int = 100_000) -> DataFrame:
    """Edges (u, v) that connect all of fp long whose bits differ in at most 3 places. fps: distinct fingerprints."""
    spark = fps.sparkSession
    n = parts_for(spark, fps.count() * len(TRIPLES), part_rows)
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    lists = F.array(*[F.lit(k << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for k, (a, b, c) in enumerate(TRIPLES)])

    def work(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            keys, own = (np.concatenate(x) for x in zip(*got))
            pairs = forest_of(keys.astype(np.int64), own.astype("<i8").view("<u8"))
            yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in pairs], pa.int64()), "v": pa.array([b for _, b in pairs], pa.int64())})

    def refine(batches):
        for b in batches:
            if b.num_rows:
                keys, own = _refined(b.column(0).to_numpy(), b.column(1).to_numpy().astype("<i8").view("<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own.view("<i8"))], names=["posting", "fp"])

    posted = fps.select(F.explode(lists).alias("posting"), "fp").select(F.col("posting").cast("long").alias("posting"), "fp")
    crowded = saved(posted.groupBy("posting").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("posting"), "crowded")
    if not crowded.isEmpty():
        dealt = posted.join(crowded, "posting", "left_semi").mapInArrow(refine, "posting long, fp long")
        posted = posted.join(crowded, "posting", "left_anti").union(dealt)
    return posted.repartition(n, "posting").mapInArrow(lean(work), "u long, v long")


def components_of(made: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of rows (doc_id, fp): the least doc_id reachable over fingerprints at 3 or fewer bits."""
    distinct = saved(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over fingerprints that SQL can make too: a product of the length of a document."""
    from strataline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce("n_chars", F.lit(0)).cast("long") * F.lit(68_719_476_731)).alias("fp"))
    return components_of(docs).select("doc_id", "component_id")


COMPONENTS_SQL = """WITH RECURSIVE d AS (SELECT doc_id, CAST(coalesce(n_chars, 0) AS BIGINT) * 68719476731 AS fp FROM documents), f AS (SELECT fp, min(doc_id) AS least FROM d GROUP BY fp),
l AS (SELECT a.fp AS i, b.fp AS j FROM f a JOIN f b ON bit_count(xor(a.fp, b.fp)) <= 3), r(i, j) AS (SELECT i, j FROM l UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT r.i AS fp, min(f.least) AS component_id FROM r JOIN f ON f.fp = r.j GROUP BY r.i) SELECT d.doc_id, c.component_id FROM d JOIN c USING (fp)"""


def near_duplicates(docs: DataFrame, shingle: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text).

    Null, empty and blank texts have fingerprint zero and are linked like any other. component_id is the least doc_id that
    can be reached; rows without doc_id take part, and a component of such rows alone has none. Repeated rows stay and are
    linked; which of equal texts comes first makes no difference. Texts are taken whole, however long. Other columns are
    ignored, whatever their names; a table without rows gives none.

    With similarity, fingerprints only give the first candidates: texts are linked whose sets of shingles have at least this
    Jaccard similarity, all of them. Returns doc_id, key (of the set), component_id then; see strataline.llm.jaccard.
    """
    if similarity is not None:
        from strataline.llm import jaccard

        return jaccard.near_duplicates(docs, shingle, similarity)
    made = saved(fingerprints(docs, shingle), "fingerprints")
    return components_of(made).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
