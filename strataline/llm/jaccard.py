"""Near-duplicates by exact Jaccard similarity of word shingles: fingerprints first, then a positional index of prefixes.

Two sets with a similarity of at least t share at least ceil(t n) members of either, n its size. With all members in one order,
the first shared one is then among the first n - ceil(t n) + 1 of both: only these prefixes are indexed, and no pair is
missed. Two texts at a similarity of 0.8 differ in about 10 of the 64 bits of their SimHashes and often in 17, a radius for
which no byte is sure to agree; fingerprints alone would lose most such pairs. So:

1. Fingerprints that differ in at most 3 bits, found by the byte-position index, are candidates at once.
2. In each posting list neighbours in different components are candidates; of those each set takes the one whose fingerprint is
   nearest. Rounds of this join large groups of near copies at about a pair a member and round.
3. All pairs of different components that meet in a posting list are candidates, where they meet first, if what follows the
   member in both can still be enough, and if their parities (for each of 256 classes of members, whether their number in the set
   is odd) differ in no more places than the sets may in members. So each pair is made once, however many members it shares.

Candidates are verified on the whole sets, so 1 and 2 bear on speed only and 3 misses nothing. The order of members is by
the number of sets that have them, rare ones first, so that common passages are in few prefixes and lists stay short at any size of
the input: documents are stored once in frames; each frame sends five bytes of each of its members to a shard, which counts and
answers with those that come again. Equal sets are one entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.functions.components import components
from strataline.llm.common import lean, parts_for, saved, scratch, text_slices
from strataline.llm.simhash import SEED, near_links
from strataline.llm.suffix_dedup import _five, _from_five, _grouped, frame_table, store_frames

HELD = 256  # members; at most 512 KB a document, whatever its length
PARITIES = 256  # classes; sets of up to about 500 members are told apart well, larger ones need the other filters
GS = [f"g{i}" for i in range(PARITIES // 64)]
APART = 20  # bits; fingerprints of unrelated texts are seldom nearer, those of texts at 0.8 seldom further apart


def shingles_of(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct hashes (i8, sorted) of the runs of `shingle` lower-cased words; all words of a shorter text are one run."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64).view(np.int64)
    return np.unique(np.array([digest(b" ".join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)))], np.uint64).view(np.int64))


def key_of(members: np.ndarray) -> int:
    """64 bits that tell sets apart; 0 for the empty set."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True) if len(members) else 0


def with_key(docs: DataFrame, name: str, shingle: int = 5) -> DataFrame:
    """docs and a column with the key of text's set."""
    k = docs.columns.index("text")

    def work(batches):
        for b in batches:
            keys = [key_of(shingles_of(t, shingle)) for t in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, name])

    return docs.mapInArrow(lean(work), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A bit (i8 in all) is 1 if set in over half the members of a set."""
    out = np.zeros(len(sets), np.int64)
    full = [i for i, m in enumerate(sets) if len(m)]
    if full:
        sizes = np.array([len(sets[i]) for i in full])
        bits = np.unpackbits(np.concatenate([sets[i] for i in full]).view("u1").reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
        out[full] = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<i8").ravel()
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), PARITIES / 64) i8: a bit is 1 if an odd number of members is of its class.

    Members that two sets share cancel out, so these differ in at most as many bits as the sets in members.
    """
    where = np.repeat(np.arange(len(sets)), [*map(len, sets)]) * PARITIES
    members = np.concatenate([*sets, np.zeros(0, np.int64)]) & (PARITIES - 1)
    odd = np.bincount(where + members, minlength=len(sets) * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(sets), PARITIES // 64)


def posted_sets(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """doc_id, key, fp, n (size), g0... (parities), s and p of every row: the prefix members that other sets have too, and where they stand in the order.

    s and p are given once a frame for each key, so many copies have few.
    """
    spark = docs.sparkSession
    uri = scratch(spark, "frames")
    frames = store_frames(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), uri)
    n_frames, total = frames.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    shards, tasks = parts_for(spark, total, 16 << 20), parts_for(spark, n_frames, 4)
    low = np.uint64((1 << 40) - 1)
    full = lambda s: (s.view("u8") >> np.uint64(40)) % np.uint64(shards) << np.uint64(40) | s.view("u8") & low
    packs = pa.schema([("shard", pa.int32()), ("frame", pa.int64()), ("n_many", pa.int32()), ("keys", pa.binary()), ("codes", pa.binary())])
    packed = "shard int, frame long, n_many int, keys binary, codes binary"

    def sets_in(frame: int):
        """(doc_ids, keys, sets) of a stored frame, a slice at a time."""
        table = frame_table(uri, frame)
        for b in table.combine_chunks().to_batches():
            for i, j, texts in text_slices(b, 1, 500_000):
                sets = [shingles_of(t, shingle) for t in texts]
                yield b.column(0)[i:j], [*map(key_of, sets)], sets

    def ask(batches):
        for b in batches:
            for f in b.column(0).to_pylist():
                seen: dict[int, np.ndarray] = {}
                for _, keys, sets in sets_in(f):
                    seen |= {k: full(m) for k, m in zip(keys, sets) if k not in seen}
                found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen.values()]), return_counts=True)
                shard = (found >> np.uint64(40)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(found) else []
                out = []
                for x, y in zip(cuts, cuts[1:]):
                    many = counts[x:y] > 1
                    out.append((int(shard[x]), f, int(many.sum()), _five(np.concatenate([found[x:y][many] & low, found[x:y][~many] & low])), np.log2(counts[x:y][many]).astype(np.uint8).tobytes()))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(packs.names, map(list, zip(*out)))), schema=packs)

    def count(batches):
        for shard, rows in _grouped(batches, "shard"):
            keys, out, at = [_from_five(r["keys"]) for r in rows], [], 0
            each = [np.concatenate([2.0 ** np.frombuffer(r["codes"], np.uint8), np.ones(len(k) - r["n_many"])]) for k, r in zip(keys, rows)]
            found, where = np.unique(np.concatenate(keys), return_inverse=True)
            code = np.minimum(255, 4 * np.log2(np.bincount(where, np.concatenate(each), minlength=len(found)))).astype(np.uint8)
            for k, r in zip(keys, rows):
                own = code[where[at : at + len(k)]]
                at += len(k)
                if (again := own > 0).any():
                    out.append((shard, r["frame"], 0, _five(k[again]), own[again].tobytes()))
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(packs.names, map(list, zip(*out)))), schema=packs)

    def post(batches):
        for f, rows in _grouped(batches, "frame"):
            rows = [r for r in rows if r["keys"]]
            known = np.concatenate([np.zeros(0, np.uint64), *(_from_five(r["keys"]) | np.uint64(r["shard"]) << np.uint64(40) for r in rows)])
            code = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["codes"], np.uint8) for r in rows)])
            order = np.argsort(known)
            known, code = np.append(known[order], np.uint64(2**64 - 1)), np.append(code[order], np.uint8(0))
            given: set[int] = set()
            for ids, keys, sets in sets_in(f):
                s, p = [], []
                for k, m in zip(keys, sets):
                    at = np.zeros(0, np.int64)
                    if k not in given and len(m):
                        given.add(k)
                        place = np.searchsorted(known, full(m))
                        own = np.where(known[place] == full(m), code[place], 0)
                        order = np.lexsort((m, own))
                        m, own = m[order], own[order]
                        at = np.flatnonzero(own[: len(m) - int(np.ceil(least * len(m) - 1e-9)) + 1])
                    s.append(m[at])
                    p.append(at)
                g = [pa.array(np.ascontiguousarray(c)) for c in parities(sets).T]
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.int64()), pa.array(simhashes(sets)), pa.array([*map(len, sets)], pa.int32()), *g, _lists(s), _lists(p)], names=["doc_id", "key", "fp", "n", *GS, "s", "p"])

    asked = frames.select("frame").repartition(tasks).mapInArrow(lean(ask), packed)
    answers = saved(asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(lean(count), packed), "answers")
    every = answers.unionByName(frames.select("frame"), allowMissingColumns=True)
    return every.repartition(tasks, "frame").sortWithinPartitions("frame").mapInArrow(lean(post), f"doc_id long, key long, fp long, n int, {', '.join(f'{g} long' for g in GS)}, s array<long>, p array<long>")


def members_of(docs: DataFrame, entries: DataFrame, shingle: int) -> DataFrame:
    """key and all members of the sets of entries (key, least: the doc_id of one of its texts)."""

    def work(batches):
        for b in batches:
            for _, _, texts in text_slices(b, 0, 500_000):
                sets = [shingles_of(t, shingle) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([*map(key_of, sets)], pa.int64()), _lists(sets)], names=["key", "members"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = entries.where("least is not null").select(F.col("least").alias("doc_id")).distinct()
    some = rows.join(ids, "doc_id", "left_semi").select("text").union(rows.where("doc_id is null").select("text"))
    found = some.mapInArrow(lean(work), "key long, members array<long>").join(entries.select("key"), "key", "left_semi")
    return found.groupBy("key").agg(F.first("members").alias("members"))  # an id may stand on several rows


def _reachable(least: float, n: Column, n2: Column) -> Column:
    """What two sets of n and n2 members share if they are similar enough."""
    return least / (1 + least) * (n + n2) - 1e-9


def _apart(least: float, n: Column, n2: Column) -> Column:
    """In how many members two sets of n and n2 members may differ if they are similar enough."""
    return (1 - least) / (1 + least) * (n + n2) + 1e-9


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, rounds: int = 3) -> DataFrame:
    """doc_id, key (of the set), component_id of every row of docs (doc_id, text); all pairs at `least` or above are linked.

    Null, empty and blank texts have the empty set and are linked with each other alone; a text of fewer words than a shingle
    is one shingle. Texts are taken whole, however long. component_id is the least doc_id that can be reached; rows without
    doc_id take part, and a component of such rows alone has none. Repeated rows stay; other columns are ignored, and a
    table without rows gives none.
    """
    spark = docs.sparkSession
    made = saved(posted_sets(docs, shingle, least), "sets")
    entries = saved(made.groupBy("key").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("fp", "n", *GS)]), "entries")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs of keys (a, b) those whose sets are similar enough, as (u, v)."""
        pairs = saved(pairs.distinct(), "pairs")
        few = max(1, pairs.count() // 100_000)  # files and tasks as the pairs need them, whatever the session's partitions
        used = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        members = saved(members_of(docs, entries.join(used, "key", "left_semi").select("key", "least"), shingle).coalesce(few), "members")
        side = lambda k: members.select(F.col("key").alias(k), F.col("members").alias(f"m_{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("m_a", "m_b")))
        return saved(both.where(F.col("shared") / (F.size("m_a") + F.size("m_b") - F.col("shared")) >= least).select(F.col("a").alias("u"), F.col("b").alias("v")).coalesce(few), "links")

    # several frames can have posted one set: each set once a list
    posted = made.where(F.size("s") > 0).select("key", "n", "fp", F.explode(F.arrays_zip("s", "p")).alias("_")).select("_.s", "key", "n", F.col("_.p").cast("int").alias("p"), "fp")
    n = parts_for(spark, made.agg(F.coalesce(F.sum(F.size("s").cast("long")), F.lit(0))).first()[0], 1_000_000)
    once = posted.repartition(n, "s").groupBy("s", "key").agg(F.min("n").alias("n"), F.min("p").alias("p"), F.min("fp").alias("fp"))
    lists = saved(once.withColumn("m", F.count("*").over(Window.partitionBy("s"))).where("m > 1").drop("m"), "lists")

    def beside(labelled: DataFrame) -> DataFrame:
        """Of each set's neighbours in lists, in other components, the one with the nearest fingerprint."""
        prev = F.lag(F.struct("key", "n", "fp", "c")).over(Window.partitionBy("s").orderBy("c", "fp", "key"))
        near = labelled.withColumn("prev", prev).where("prev.key != key and (c is null or prev.c != c)").withColumn("apart", F.bit_count(F.col("fp").bitwiseXOR(F.col("prev.fp"))))
        near = near.where((F.col("apart") <= APART) & (F.least("n", "prev.n") >= _reachable(least, F.col("n"), F.col("prev.n"))))
        ends = F.explode(F.array(F.struct(F.col("key").alias("own"), F.col("prev.key").alias("other")), F.struct(F.col("prev.key").alias("own"), F.col("key").alias("other"))))
        best = near.select("apart", ends.alias("e")).groupBy("e.own").agg(F.min_by("e.other", "apart").alias("other"))
        return best.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    fps = saved(entries.where("n > 0").groupBy("fp").agg(F.min("key").alias("a")), "fingerprints")
    equal = entries.join(fps, "fp").where("key != a").select("a", F.col("key").alias("b"))
    u, v = (fps.select(F.col("fp").alias(k), F.col("a").alias(f"k_{k}")) for k in "uv")
    near = near_links(fps.select("fp")).join(u, "u").join(v, "v").select(F.least("k_u", "k_v").alias("a"), F.greatest("k_u", "k_v").alias("b"))
    links = verified(equal.union(near).union(beside(lists.withColumn("c", F.lit(None).cast("long")))))
    label = lambda: lists.join(components(links).withColumnRenamed("id", "key"), "key", "left").select("s", "key", "n", "p", "fp", F.coalesce("root", "key").alias("c"))
    for _ in range(rounds):
        more = verified(beside(saved(label(), "labelled")))
        if more.isEmpty():
            break
        links = links.union(more)

    # pairs of different components, wherever a list has several
    now = saved(label(), "labelled")
    several = now.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("s")
    now = now.join(several, "s", "left_semi")
    # with each posting the members before it: a pair meets first where these have none in common. Those of a prefix longer than HELD
    # are not repeated at each of its postings, as they would take the square of its length; its pairs come up each time, and once from distinct
    own = now.groupBy("key").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("p", "s"))).alias("all"))
    own = own.join(entries.select("key", *GS), "key").withColumn("held", F.when(F.size("all") <= HELD, F.col("all")["s"]).otherwise(F.array().cast("array<long>")))
    now = own.select("key", "n", "c", *GS, "held", F.posexplode("all").alias("i", "e")).select("e.s", "e.p", "key", "n", "c", *GS, F.slice("held", F.lit(1), F.col("i")).alias("before"))
    x, y = (now.select("s", *[F.col(k).alias(f"{k}_{side}") for k in ("key", "n", "p", "c", "before", *GS)]) for side in "xy")
    enough = F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y")) >= _reachable(least, F.col("n_x"), F.col("n_y"))
    odd = sum((F.bit_count(F.col(f"{g}_x").bitwiseXOR(F.col(f"{g}_y"))) for g in GS), F.lit(0))
    enough &= odd <= _apart(least, F.col("n_x"), F.col("n_y"))
    first = ~F.arrays_overlap("before_x", "before_y")
    across = verified(x.join(y, (x["s"] == y["s"]) & (F.col("key_x") < F.col("key_y")) & (F.col("c_x") != F.col("c_y")) & enough & first).select(F.col("key_x").alias("a"), F.col("key_y").alias("b")))

    roots = components(links.union(across))
    rooted = entries.select("key", "least").join(roots.withColumnRenamed("id", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return made.select("doc_id", "key").join(named, "key")
