"""Mixture-controlled packing of token streams into sequences of fixed length.

Documents wait in one queue for each source. Deficit round-robin gives every source, window after window, a quantum of
tokens in proportion to its target; what it cannot send as whole tokens stays as its deficit for the next window. When
a queue runs dry its share passes to the others, so that no token is lost.

Across partitions the same schedule is followed in closed form. With weight w_s and N_s tokens in source s, at virtual
time v each source has sent min(w_s v, N_s) tokens, and T(v) = sum of these is piecewise linear. Partition p of P covers
the v for which T(v) runs from p T/P to (p+1) T/P, and has of source s exactly the tokens from floor(w_s v_p) to
floor(w_s v_{p+1}): the fraction that does not fit is the deficit carried into the next partition. So any task can cut
any document knowing only the totals of the sources (one row a source, read by the driver) and the tokens before the
document in its queue (those of the tasks before its own, and a running sum inside it). Each partition of at most `windows` full windows is filled
by one task, whatever the skew of sources or documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm.common import lean, parts_for, saved, text_slices, tokenizer_encoder

WINDOW = 2048


class Schedule:
    """Who sends which tokens in which partition; a pure function of the sources' totals and weights."""

    def __init__(self, totals: dict, weights: dict | None, window: int, windows: int):
        self.names = sorted((s for s, n in totals.items() if n), key=lambda s: (s is not None, str(s)))
        self.n = np.array([totals[s] for s in self.names], np.int64)
        w = self.n / max(1, self.n.sum()) if weights is None else np.array([float(weights.get(s, 0)) for s in self.names])
        self.w = np.where(w > 0, w, (w[w > 0].min() if (w > 0).any() else 1.0) * 1e-3)  # no target: last, but never lost
        self.index = {s: i for i, s in enumerate(self.names)}
        self.total, self.window = int(self.n.sum()), window
        room = max(window, windows * window - len(self.names))  # rounding moves a partition's total by a token a source at most
        self.parts = max(1, -(-self.total // room))
        self.dry = np.unique(self.n / self.w)
        self.sent = np.array([np.minimum(self.w * v, self.n).sum() for v in self.dry])

    def time_of(self, tokens: np.ndarray) -> np.ndarray:
        """The virtual time at which so many tokens have been sent."""
        return np.interp(tokens, np.concatenate([[0.0], self.sent]), np.concatenate([[0.0], self.dry]))

    def cut(self, source: int, parts: np.ndarray) -> np.ndarray:
        """The tokens of a source sent before each of these partitions."""
        parts = np.asarray(parts, np.int64)
        v = self.time_of(parts * (self.total / self.parts))
        got = np.minimum(np.floor(self.w[source] * v).astype(np.int64), self.n[source])
        return np.where(parts <= 0, 0, np.where(parts >= self.parts, self.n[source], got))

    def whole(self, sources: list, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The one partition that holds a row's tokens; -1 where several do, or it is too close to a boundary to tell."""
        out = np.full(len(starts), -1, np.int64)
        own = np.array([self.index[s] for s in sources], np.int64)
        for s in np.unique(own):
            at = np.flatnonzero(own == s)
            v = (starts[at] + lengths[at] / 2) / self.w[s]
            p = np.floor(np.interp(v, np.concatenate([[0.0], self.dry]), np.concatenate([[0.0], self.sent])) / (self.total / self.parts)).astype(np.int64)
            p = np.clip(p, 0, self.parts - 1)
            out[at] = np.where((self.cut_of(s, p) <= starts[at]) & (self.cut_of(s, p + 1) >= starts[at] + lengths[at]), p, -1)
        return out

    def cut_of(self, source: int, parts: np.ndarray) -> np.ndarray:
        """cut for many partitions, each once."""
        known, where = np.unique(parts, return_inverse=True)
        return self.cut(source, known)[where]

    def pieces(self, source: int, start: int, length: int) -> list[tuple[int, int, int]]:
        """(partition, from, to) of the stream positions start to start + length of a source."""
        v = np.array([start, start + length]) / self.w[source]
        p = np.interp(v, np.concatenate([[0.0], self.dry]), np.concatenate([[0.0], self.sent])) / (self.total / self.parts)
        parts = np.arange(max(0, int(p[0]) - 2), min(self.parts, int(p[1]) + 3) + 1)
        cuts = np.clip(self.cut(source, parts), start, start + length)
        return [(int(parts[i]), int(cuts[i]), int(cuts[i + 1])) for i in np.flatnonzero(np.diff(cuts))]


def fill_windows(amounts: np.ndarray, window: int) -> np.ndarray:
    """Deficit round-robin over one partition: tokens of each source in each window, an array (windows, sources)."""
    left = amounts.astype(np.int64).copy()
    share = amounts / amounts.sum()
    deficit = np.zeros(len(left))
    out = []
    while total := int(left.sum()):
        room = min(window, total)
        deficit += share * room
        send = np.clip(np.floor(deficit).astype(np.int64), 0, left)
        if (over := int(send.sum()) - room) > 0:
            for s in np.argsort(deficit - send, kind="stable"):
                d = min(over, int(send[s]))
                send[s] -= d
                over -= d
        while (short := room - int(send.sum())) > 0:  # whole tokens are left over: round after round to the largest deficits
            order = np.argsort(-(deficit - send), kind="stable")
            order = order[(left - send)[order] > 0][:short]
            even = max(1, short // max(1, len(order)))
            send[order] += np.minimum(even, (left - send)[order])
        deficit -= send
        left -= send
        deficit[left == 0] = 0
        out.append(send)
    return np.array(out)


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, spaces: bool = True) -> DataFrame:
    """doc_id, source, n_tokens, ids of each row's whole text and the end id; no shuffle.

    ids are little-endian u16 where the vocabulary allows it, else u32. part is the task, inside the number of tokens of the
    same source before the row in that task.
    """

    def work(batches):
        from pyspark import TaskContext

        enc = tokenizer_encoder(tokenizer_path, spaces)
        kind = id_type(len(enc.edge), end_id)
        part, sent = TaskContext.get().partitionId(), {}
        for b in batches:
            sources = b.column(1).to_pylist()
            for i, j, texts in text_slices(b, 2):
                flat, n = enc.encode(texts)
                raw = np.insert(flat, np.cumsum(n), end_id).astype(kind).tobytes()
                tops = np.concatenate([[0], np.cumsum(n + 1)]) * np.dtype(kind).itemsize
                inside = []
                for s, k in zip(sources[i:j], (n + 1).tolist()):
                    inside.append(sent.get(s, 0))
                    sent[s] = inside[-1] + k
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(n + 1, pa.int64()), pa.array([raw[x:z] for x, z in zip(tops, tops[1:])], pa.binary()), pa.array([part] * (j - i), pa.int32()), pa.array(inside, pa.int64())], names=["doc_id", "source", "n_tokens", "ids", "part", "inside"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(lean(work), "doc_id long, source string, n_tokens long, ids binary, part int, inside long")


def vocabulary_size(tokenizer_path: str) -> int:
    return len(tokenizer_encoder(tokenizer_path, True).edge)


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, weights: dict | None = None, window: int = WINDOW, windows: int = 512, spaces: bool = True, ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, source, text) in sequences of `window` tokens.

    weights: target proportion of each source; default each source's share of all tokens. Sources without one (null is a
    source too) come last. A source is a part of a mixture, of which there are few: a row each comes to the driver. Each row is a
    document, also a repeated one; a null or empty text has the end id alone, and a text is encoded whole, however long.
    Of each group of `windows` sequences only the last can be short of `window`. Rows of a source follow each other as the table
    gives them, so ties need no order. Other columns are ignored, whatever their names; a table without rows gives none.
    Returns doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian u32).
    """
    spark = docs.sparkSession
    made = saved(tokenize(docs, tokenizer_path, end_id, spaces), "tokens")
    # Tokens before a document in its queue: those of its source in the tasks before, and those inside its own.
    sums = saved(made.groupBy("source", "part").agg(F.sum("n_tokens").alias("n")), "sums")
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row a source
    schema = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids
    if not totals:
        return spark.createDataFrame([], schema)
    plan = Schedule(totals, weights, window, windows)
    kind = id_type(vocabulary_size(tokenizer_path), end_id)
    size = np.dtype(kind).itemsize
    # a row a source and task: a written table, whose size the planner knows, so it broadcasts it only when that is small
    before = saved(sums.select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before")), "before")
    placed = made.join(before, (made["part"] == before["part"]) & made["source"].eqNullSafe(before["source"])).select("doc_id", made["source"], "n_tokens", "ids", (F.col("before") + F.col("inside")).alias("queue_start"))

    def cut(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            whole = plan.whole(b.column("source").to_pylist(), b.column("queue_start").to_numpy(), b.column("n_tokens").to_numpy())
            i = 0
            for doc_id, source, n, raw, q in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "n_tokens", "ids", "queue_start"))):
                s = plan.index[source]
                if whole[i] >= 0:
                    parts = [(int(whole[i]), q, q + n)]
                else:
                    parts = plan.pieces(s, q, n)
                i += 1
                for p, a, z in parts:
                    for o, x in zip(out, (p, s, a, doc_id, a - q, z - a, n, raw[size * (a - q) : size * (z - q)])):
                        o.append(x)
            yield pa.RecordBatch.from_pydict(dict(zip(names, out)), schema=pieces_schema)

    names = ["part", "s", "at", "doc_id", "start", "length", "doc_tokens", "ids"]
    pieces_schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def fill(batches):
        held: list[tuple] = []

        def flush():
            amounts = np.zeros(len(plan.names), np.int64)
            for r in held:
                amounts[r[1]] += r[5]
            live = np.flatnonzero(amounts)
            quota = fill_windows(amounts[live], window)
            edges = np.vstack([np.zeros((1, len(live)), np.int64), np.cumsum(quota, 0)])
            offsets = np.cumsum(quota, 1) - quota
            first = held[0][0] * (windows + 1)
            out = {n: [] for n in out_names}
            by_source: dict[int, list] = {}
            for r in held:
                by_source.setdefault(r[1], []).append(r)
            for c, s in enumerate(live.tolist()):
                rows = by_source[s]
                ends = np.cumsum([r[5] for r in rows])
                tops = ends - [r[5] for r in rows]
                bounds = np.union1d(np.append(tops, ends[-1]), edges[:, c])  # a piece ends with its document or its window
                x, y = bounds[:-1], bounds[1:]
                row, k = np.searchsorted(tops, x, "right") - 1, np.searchsorted(edges[:, c], x, "right") - 1
                wide = memoryview(np.frombuffer(b"".join([r[7] for r in rows]), kind).astype("<u4").tobytes())
                cuts = list(zip((4 * x).tolist(), (4 * y).tolist()))
                names_of = np.array([-1 if r[3] is None else r[3] for r in rows])
                out["doc_id"].append(pa.array(names_of[row], mask=np.array([r[3] is None for r in rows])[row]))
                out["source"].append(pa.array([plan.names[s]] * len(x), pa.string()))
                out["start"].append(np.array([r[4] for r in rows])[row] + x - tops[row])
                out["length"].append(y - x)
                out["ids_crc32"].append([zlib.crc32(wide[i:j]) for i, j in cuts])
                out["doc_tokens"].append(np.array([r[6] for r in rows])[row])
                out["sequence_id"].append(first + k)
                out["offset"].append(offsets[k, c] + x - edges[k, c])
                if ids:
                    out["ids"].append([bytes(wide[i:j]) for i, j in cuts])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(v, f.type) if not isinstance(v, pa.Array) else v.cast(f.type) for v in out[f.name]]) for f in out_schema], schema=out_schema)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in names)):
                if held and held[0][0] != r[0]:
                    yield flush()
                    held.clear()
                held.append(r)
        if held:
            yield flush()

    out_names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
    out_schema = pa.schema([(n, {"ids": pa.binary(), "source": pa.string()}.get(n, pa.int64())) for n in out_names])
    cuts = placed.mapInArrow(cut, "part long, s long, at long, doc_id long, start long, length long, doc_tokens long, ids binary")
    n = parts_for(spark, plan.parts, 8)
    return cuts.repartition(n, "part").sortWithinPartitions("part", "s", "at").mapInArrow(lean(fill), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strataline.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
