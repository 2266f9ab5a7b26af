"""Periodic runs of words by a harmonic grid of common-extension queries.

A run of period p and length >= 4p covers at least four neighbouring multiples of p, so for each p only the grid positions
jp have to be looked at: how far do the words from jp and from (j+1)p on agree to the right, and how far to the left of
them. Both extensions together give the run. There are n/1 + n/2 + ... = O(n log n) such queries, each answered in constant
time: an extension to the right is the least common prefix between two places of the suffix array (range minimum by block
minima), one to the left the same on the reversed words.

Documents are independent: words become numbers within a slice of documents, each document ends in a number of its own, so
that no extension leaves it. Grid pairs whose words differ, or that have no third and fourth grid word like them, cannot
lie in a run; the arrays are built over those documents only that have a grid pair left. No shuffle, and memory is
linear in the longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import lean, table

FOLD, LEAST = 4, 6
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
BLOCK = 16
WIDE = 1024


class RangeMinimum:
    """Least value of ranges: minima from block starts and to block ends, and of 2^k whole blocks."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK) * BLOCK
        self.values = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        rows = self.values.reshape(-1, BLOCK)
        self.since = np.minimum.accumulate(rows, axis=1).ravel()
        self.until = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(1)]
        while 2 << (len(self.levels) - 1) <= len(rows):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over lo..hi, both included."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.until[lo], self.since[hi])
        near = np.flatnonzero(a == b)
        if len(near):
            out[near] = np.iinfo(np.int32).max
            for k in range(BLOCK):
                at = near[lo[near] + k <= hi[near]]
                out[at] = np.minimum(out[at], self.values[lo[at] + k])
        far = np.flatnonzero(b - a > 1)
        if len(far):
            first, count = a[far] + 1, b[far] - a[far] - 1
            level = np.frexp(count)[1] - 1
            for k in np.unique(level).tolist():
                own = far[level == k]
                x, y = a[own] + 1, b[own] - (1 << k)
                out[own] = np.minimum(out[own], np.minimum(self.levels[k][x], self.levels[k][y]))
        return out


def word_suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of numbers; its first entry is the empty suffix.

    Places are settled by 1, 2, 4, ... numbers; a round sorts only what shares its place with others.
    """
    n = len(s)
    place = np.searchsorted(np.sort(s), s)
    open_ = np.flatnonzero(np.bincount(place, minlength=n)[place] > 1)
    k = 1
    while len(open_):
        after = np.zeros(len(open_), np.int64)
        inside = open_ + k < n
        after[inside] = place[open_[inside] + k] + 1
        key = place[open_] * (n + 1) + after
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        at = np.arange(len(key))
        old = np.maximum.accumulate(np.where(np.concatenate([[True], place[open_[1:]] != place[open_[:-1]]]), at, 0))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        place[open_] += np.maximum.accumulate(np.where(first, at, 0)) - old
        open_ = open_[~(first & np.append(first[1:], True))]
        k *= 2
    sa = np.empty(n + 1, np.int64)
    sa[0] = n
    sa[place + 1] = np.arange(n)
    return sa


def word_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of sa the number of words that its suffix shares with the one before it; none at the first.

    Permuted: positions that are multiples of large powers of two first, those between them go on where these leave off.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)
    # windows over what follows each position; the end stands behind s many times, but no comparison gets there twice
    padded = np.concatenate([s, np.full(WIDE, -1, s.dtype)])

    def extend(at: np.ndarray):
        at = at[before[at] >= 0]
        while len(at):
            size = WIDE if len(at) * WIDE <= len(s) else 8
            ahead = np.lib.stride_tricks.sliding_window_view(padded, size)
            k = shared[at]
            apart = ahead[at + k] != ahead[before[at] + k]
            shared[at] = k + np.where(whole := ~apart.any(1), size, apart.argmax(1))
            at = at[whole]

    extend(np.zeros(min(n, 1), np.int64))
    step = 1 << max(0, n - 1).bit_length()
    while step := step >> 1:
        at = np.arange(step, n, 2 * step)
        shared[at] = np.maximum(0, shared[at - step] - step)
        shared[at[before[at] < 0]] = 0
        extend(at)
    return shared[sa]


class Extensions:
    """How many words agree from two positions on."""

    def __init__(self, s: np.ndarray):
        sa = word_suffix_array(s)
        self.rank = np.empty(len(sa), np.int64)
        self.rank[sa] = np.arange(len(sa))
        self.least = RangeMinimum(word_prefixes(np.append(s, 0), sa))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.least(np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)


def _grid(s: np.ndarray, longest: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid positions i and periods p whose words at i, i + p, ..., i + (fold-1)p are equal."""
    at, periods = [], []
    for p in range(1, longest // fold + 1):
        own = s[::p]
        same = own[1:] == own[:-1]
        for k in range(1, fold - 1):
            if k == 1 and not same.any():
                break
            same = same[:-1] & (own[1 + k :] == own[k:-1])[: len(same) - 1]
        if len(j := np.flatnonzero(same)) and len(same) == len(own) - (fold - 1):
            at.append(j * p)
            periods.append(np.full(len(j), p))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(periods)


def runs_in(codes: np.ndarray, sizes: np.ndarray, fold: int = FOLD, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start, then period.

    codes: words of all documents one after another as numbers from 0; sizes: words of each document.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(sizes))]
    if not len(codes) or sizes.max() < max(least, fold):
        return out

    def joined(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of docs, each with an end of its own, as numbers from 1, and where each begins."""
        n = sizes[docs] + 1
        first = np.cumsum(n) - n
        s = np.empty(int(n.sum()), np.int32)
        ends = first + n - 1
        words = np.ones(len(s), bool)
        words[ends] = False
        own = np.repeat(starts[docs] - first, n)[words] + np.flatnonzero(words)
        s[ends] = 1 + np.arange(len(docs))
        s[words] = codes[own] + 1 + len(docs)
        return s, first

    starts = np.cumsum(sizes) - sizes
    every = np.arange(len(sizes))
    s, first = joined(every)
    i, p = _grid(s, int(sizes.max()), fold)
    doc = np.searchsorted(first, i, "right") - 1
    inside = (i + (fold - 1) * p < first[doc] + sizes[doc]) & (fold * p <= sizes[doc])
    i, p, doc = i[inside], p[inside], doc[inside]
    if not len(i):
        return out
    docs, place = np.unique(doc, return_inverse=True)
    s, own = joined(docs)
    i = i - first[doc] + own[place]
    ahead, back = Extensions(s), Extensions(s[::-1].copy())
    right, n = ahead(i, i + p), len(s)
    left = np.zeros(len(i), np.int64)
    some = np.flatnonzero((i > 0) & (i + p < n))
    left[some] = back(n - i[some], n - i[some] - p[some])
    start, length = i - left, left + right + p
    whole = length >= np.maximum(least, fold * p)
    start, length, p, place = start[whole], length[whole], p[whole], place[whole]
    order = np.lexsort((p, length, start))
    start, length, p, place = start[order], length[order], p[order], place[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # a stretch's least period comes first
    start, length, p, place = start[new], length[new], p[new], place[new]
    order = np.lexsort((p, start))
    for k in order.tolist():
        d = int(place[k])
        out[int(docs[d])].append((int(start[k] - own[d]), int(length[k]), int(p[k])))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words without those that stand in a run behind its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.zeros(len(words) + 1, np.int64)
    for start, length, p in runs:
        keep[start + p] += 1
        keep[start + length] -= 1
    return b" ".join([w for w, drop in zip(words, np.cumsum(keep)[:-1].tolist()) if not drop])


def periodic_runs(docs: DataFrame, fold: int = FOLD, least: int = LEAST, slice_bytes: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of every row of docs (doc_id, text).

    A run is a longest stretch of at least max(least, fold * period) words (pieces between ASCII white space) in which words
    a period apart are equal; period is its smallest one. collapsed leaves out what a run repeats and joins the rest by single spaces.
    Null, empty and blank texts have no words, no runs and an empty collapsed text. Texts are taken whole, however long. Rows
    are independent: repeated rows and rows without doc_id give a row each; other columns are ignored, whatever their names; a
    table without rows gives none. fold is at least 3.
    """

    def work(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + slice_bytes, "right")))
                words = [(t or b"").split() for t in texts[i:j].to_pylist()]
                sizes = np.array([*map(len, words)], np.int64)
                flat = pa.array([w for own in words for w in own], pa.large_binary())
                codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
                runs = runs_in(codes, sizes, fold, least)
                rows = [[{"start": a, "length": n, "period": p} for a, n, p in own] for own in runs]
                text = pa.array([*map(collapsed, words, runs)], pa.binary()).view(pa.string())  # the bytes as they were
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(sizes), pa.array(rows, kind), text], names=["doc_id", "n_words", "runs", "collapsed"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def words_of(text: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document by its hash repeats a stretch of itself up to its end.

    Documents without doc_id or words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("w").cast("long"), F.expr("h div 10")
    a = g % n
    p = 1 + F.expr("(n - a) div (3 + g % 8)")
    # no lambda over the words: the planner would split the text anew for each of them
    again = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a)))")
    made = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words_of("text"))).withColumn("n", n).withColumn("g", g)
    made = made.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    return made.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Of each row of periodic_runs the number of runs, the one repeated most, and hashes of runs and collapsed text."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUNS[6:-1]), lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    cols = [F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")]
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *cols, F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted(table(spark, sf_dir, "documents"))))


PERIODIC_SQL = r"""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CASE WHEN doc_id IS NULL THEN 1 ELSE
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) END AS h FROM documents),
e AS (SELECT doc_id, w, h, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS e FROM c),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // e) + 1] END) ELSE w END AS w FROM e),
x AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM d),
l AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM l),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / CAST(period AS DOUBLE) DESC, start, period) AS k FROM r),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
p AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN o ON x.doc_id = o.doc_id AND x.i = o.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(t.runs, '')) AS runs_sha256,
  sha256(coalesce(p.kept, '')) AS collapsed_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN p ON p.doc_id = d.doc_id"""
