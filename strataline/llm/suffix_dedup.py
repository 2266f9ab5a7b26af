"""Removal of repeated byte strings by suffix arrays over shards.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Which shard must
see which strings follows from minimizers: each string of `length` bytes has one (the least hash among its 24-byte
strings), so equal strings meet in the shard of their common minimizer.

1. Documents are stored once, in frames of a few MB in the shared folder; later steps read a frame by its number, so no
   text is shuffled.
2. Each frame sends the distinct minimizers of its strings, 6 bytes each with the size of their number, to shards by hash,
   which answer with those that more than one document has. A hot one comes at most once from each frame.
3. Maximal runs of strings with the same repeated minimizer are sent, as text, to shards; equal ones of a frame once, with
   the documents that have them. A minimizer with more text than a part of a shard is hot: its runs are cut further by the
   minimizers of one or two other hashes, which lie in the strings' different contexts, and those cuts go to shards of their own.
   A shard builds its suffix array by induced sorting over the distinct texts that share their minimizer with another, bounds groups
   of equal `length`-byte strings by permuted common prefixes, and takes the least doc_id of each; a text alone under its minimizer
   has no string of any other. It answers with the intervals to remove in each document.
4. Each frame applies its intervals. All strings are judged on the input, not on what is left.

Minimizers only choose where strings meet; two different strings never count as equal, whatever their hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import lean, parts_for, saved, scratch
from strataline.llm.suffixes import common_prefixes, suffix_array
from strataline.llm.token_files import FrameReader, FrameWriter, filesystem, put_in_place

LENGTH, SEED_BYTES, FRAME_BYTES, SHARD_BYTES, FRAMES = 50, 24, 4 << 20, 4 << 20, 1 << 24
HOT_BYTES = 1 << 19  # text of one minimizer, as estimated, above which its runs are cut further
NEVER_SMALLER = np.iinfo(np.int64).max  # a row without doc_id


def window_minima(buf: np.ndarray, length: int = LENGTH, k: int = SEED_BYTES, step: int = 1 << 16, other: int = 0) -> np.ndarray:
    """For each position the least hash among the k-byte strings of the `length` bytes from there; other: number of another hash."""
    n, span = len(buf) - length + 1, length - k + 1
    out = np.empty(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, step):
            z = min(n, a + step)
            count = z - a + span - 1
            part = np.ascontiguousarray(buf[a : a + count + k - 1])
            h = np.full(count, other, np.uint64)
            for d in range(0, k, 8):
                h += np.ndarray((count,), "<u8", part, d, (1,))
                h *= np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            size = 1
            while 2 * size <= span:
                h = np.minimum(h[:-size], h[size:])
                size *= 2
            out[a:z] = np.minimum(h[: z - a], h[span - size : span - size + z - a])
    return out


class Frame:
    """The documents of one stored frame, and the runs of its strings by minimizer."""

    def __init__(self, table: pa.Table):
        self.table = table
        raw = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.buf = np.frombuffer(b"".join(raw), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        self.ids = np.array([NEVER_SMALLER if d is None else d for d in table.column("doc_id").to_pylist()], np.int64)

    def runs(self, shards: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minimizer key (shard << 40 | 40 bits), first string, end of strings and document of each maximal run."""
        m = window_minima(self.buf, length)
        stops = np.maximum(self.off[:-1], self.off[1:] - length + 1)
        first = np.zeros(len(m) + 1, bool)
        first[1 : len(m)] = m[1:] != m[:-1]
        has = stops > self.off[:-1]
        first[self.off[:-1][has]] = True
        valid = np.zeros(len(m) + 1, np.int8)
        valid[self.off[:-1][has]] += 1
        valid[stops[has]] -= 1
        starts = np.flatnonzero(first[:-1] & (np.cumsum(valid[:-1]) > 0))
        doc = np.searchsorted(self.off, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(m)), stops[doc])
        m = m[starts]
        return (m & np.uint64(0xFFFFFF)) % np.uint64(shards) << np.uint64(40) | m >> np.uint64(24), starts, ends, doc


def cut_further(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, twice: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings (first, end) cut where the minimizer of a second hash changes, or (twice) of a second or third.

    Returns run, first, end and a hash of the further minimizers. Equal strings get equal hashes, wherever they are.
    """
    sizes = ends - starts + length - 1
    base = np.cumsum(sizes) - sizes
    text = buf[np.repeat(starts - base, sizes) + np.arange(int(sizes.sum()))]
    run = np.repeat(np.arange(len(starts)), ends - starts)
    step = np.arange(len(run)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    at = base[run] + step
    mark = window_minima(text, length, other=1)[at]
    if twice.any():
        more = window_minima(text, length, other=2)[at]
        mark = np.where(twice[run], mark * np.uint64(0x9E3779B97F4A7C15) ^ more, mark)
    first = np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]) | (run[1:] != run[:-1])])[: len(run)])
    own = run[first]
    return own, starts[own] + step[first], starts[own] + step[np.append(first[1:], len(run)) - 1] + 1, mark[first]


def _five(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view("u1").reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel().astype(np.uint64)


def _six(keys: np.ndarray, code: np.ndarray) -> bytes:
    """40-bit keys with a byte behind each."""
    wide = keys.astype("<u8").view("u1").reshape(-1, 8)[:, :6].copy()
    wide[:, 5] = code
    return wide.tobytes()


def _from_six(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return _from_five(np.ascontiguousarray(wide[:, :5]).tobytes()), wide[:, 5]


def _grouped(batches, key: str):
    """(value of key, list of rows) for each run of equal keys over a sorted partition."""
    held, now = [], None
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def store_frames(docs: DataFrame, uri: str) -> DataFrame:
    """docs as frames of Arrow data; returns frame (its number) and n_bytes."""

    def write(batches):
        from pyspark import TaskContext

        part, out, writer, held, size, rows = TaskContext.get().partitionId(), None, None, [], 0, []

        def flush():
            nonlocal out, writer, own, path, fs
            if writer is None:
                fs, path = filesystem(f"{uri}/part-{part:08d}.frames")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(own)
                writer = FrameWriter(out)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as s:
                for h in held:
                    s.write_batch(h)
            rows.append((part * FRAMES + writer.frames_written, size))
            writer.content(sink.getvalue().to_pybytes())
            held.clear()

        own = path = fs = None
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            lens = np.array([n or 0 for n in pa.compute.binary_length(texts).to_pylist()], np.int64)
            i = 0
            while i < len(lens):
                j = i + max(1, int(np.searchsorted(np.cumsum(lens[i:]) + size, FRAME_BYTES)) + 1)
                held.append(b.slice(i, j - i))
                size += int(lens[i:j].sum())
                i = min(j, len(lens))
                if size >= FRAME_BYTES:
                    flush()
                    size = 0
        if held:
            flush()
        if writer is not None:
            writer.close()
            out.close()
            put_in_place(fs, own, path)
            yield pa.RecordBatch.from_pydict({"frame": pa.array([f for f, _ in rows], pa.int64()), "n_bytes": pa.array([n for _, n in rows], pa.int64())})

    return saved(docs.mapInArrow(lean(write), "frame long, n_bytes long"), "frames")


def frame_table(uri: str, frame: int) -> pa.Table:
    with pa.ipc.open_stream(FrameReader(f"{uri}/part-{frame // FRAMES:08d}.frames").content(frame % FRAMES)) as s:
        return s.read_all()


def _load(uri: str, frame: int) -> Frame:
    return Frame(frame_table(uri, frame))


def remove_repeats(docs: DataFrame, finish, schema, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, more) through finish(frame, removed), which gives an Arrow batch of schema for each frame.

    removed: a mask over the frame's bytes. Null texts are empty; rows without doc_id lose what others have, and take nothing
    from others; rows under one doc_id take nothing from each other, so repeated rows stay as they are. Texts shorter than
    length lose nothing; a text is taken whole, up to the 2 GiB that one Arrow value holds. Other columns go through, whatever
    their names. A table without rows gives none.
    """
    spark = docs.sparkSession
    uri = scratch(spark, "frames")
    frames = store_frames(docs, uri)
    n_frames, total = frames.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    shards = parts_for(spark, total, 24 << 20)
    tasks = parts_for(spark, n_frames, 4)

    def minimizers(batches):
        for b in batches:
            for f in b.column(0).to_pylist():
                keys, _, _, doc = _load(uri, f).runs(shards, length)
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(keys)) - 1
                many = doc[first] != doc[last]
                keys = keys[first]
                code = np.log2(np.maximum(1, np.diff(np.append(first, len(doc))))).astype(np.uint8)
                shard = (keys >> np.uint64(40)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(keys) else []
                out = []
                for a, z in zip(cuts, np.append(cuts[1:], len(keys))):
                    k, r, n = keys[a:z] & np.uint64((1 << 40) - 1), many[a:z], code[a:z]
                    out.append((int(shard[a]), f, int(r.sum()), _six(np.concatenate([k[r], k[~r]]), np.concatenate([n[r], n[~r]]))))
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(("shard", "frame", "n_many", "keys"), map(list, zip(*out)))), schema=pa.schema([("shard", pa.int32()), ("frame", pa.int64()), ("n_many", pa.int32()), ("keys", pa.binary())]))

    def repeated(batches):
        for shard, rows in _grouped(batches, "shard"):
            keys, codes = zip(*(_from_six(r["keys"]) for r in rows))
            many = np.concatenate([np.arange(len(k)) < r["n_many"] for k, r in zip(keys, rows)])
            found, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            hit = (counts > 1) | (np.bincount(inverse[many], minlength=len(found)) > 0)
            text = np.bincount(inverse, 1.5 * 2.0 ** np.concatenate(codes), minlength=len(found)) * 1.5 * length
            split = np.ceil(np.log2(np.maximum(1, text / HOT_BYTES))).astype(np.uint8)
            hits, at, out = hit[inverse], 0, []
            for k, r in zip(keys, rows):
                own = hits[at : at + len(k)]
                if own.any():
                    out.append((r["frame"], shard, _six(k[own], split[inverse[at : at + len(k)][own]])))
                at += len(k)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(("frame", "shard", "keys"), map(list, zip(*out)))), schema=pa.schema([("frame", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary())]))

    asked = frames.select("frame").repartition(tasks).mapInArrow(lean(minimizers), "shard int, frame long, n_many int, keys binary")
    answers = saved(asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(lean(repeated), "frame long, shard int, keys binary"), "repeated")
    runs = answers.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] / 6
    text_shards = parts_for(spark, runs * 1.3 * length, SHARD_BYTES)
    packet = pa.schema([("shard", pa.int32()), ("frame", pa.int64()), ("text", pa.binary()), ("lens", pa.binary()), ("key", pa.binary()), ("n", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary()), ("id", pa.binary())])

    def texts(batches):
        for f, rows in _grouped(batches, "frame"):
            wanted, split = (np.concatenate(x) for x in zip(*((k | np.uint64(r["shard"]) << np.uint64(40), c) for r in rows for k, c in [_from_six(r["keys"])])))
            order = np.argsort(wanted)
            wanted, split = wanted[order], split[order]
            frame = _load(uri, f)
            keys, starts, ends, doc = frame.runs(shards, length)
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            use = wanted[at] == keys
            keys, starts, ends, doc, split = keys[use], starts[use], ends[use], doc[use], split[at[use]]
            if (hot := split > 0).any():
                own, a, z, mark = cut_further(frame.buf, starts[hot], ends[hot], split[hot] > 4, length)
                starts, ends, doc = np.append(starts[~hot], a), np.append(ends[~hot], z), np.append(doc[~hot], doc[hot][own])
                keys = np.append(keys[~hot], keys[hot][own] ^ mark)
            ends = ends + length - 1
            shard = ((keys ^ keys >> np.uint64(21)) % np.uint64(text_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            raw = frame.buf.tobytes()
            short = keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(order) else []
            out = []
            for x, y in zip(cuts, np.append(cuts[1:], len(order))):
                own = order[x:y]
                seen: dict[bytes, list[int]] = {}
                for i, a, z in zip(own.tolist(), starts[own].tolist(), ends[own].tolist()):
                    seen.setdefault(raw[a:z], []).append(i)
                at = np.array([i for v in seen.values() for i in v], np.int64)
                out.append((int(shard[own[0]]), f, b"".join(seen), np.array([*map(len, seen)], "<u4").tobytes(), short[[v[0] for v in seen.values()]].astype("<u4").tobytes(), np.array([*map(len, seen.values())], "<u4").tobytes(), doc[at].astype("<u4").tobytes(), (starts[at] - frame.off[doc[at]]).astype("<u4").tobytes(), frame.ids[doc[at]].astype("<i8").tobytes()))
                if sum(len(o[2]) for o in out) > 8 << 20:
                    yield pa.RecordBatch.from_pydict(dict(zip(packet.names, map(list, zip(*out)))), schema=packet)
                    out = []
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(packet.names, map(list, zip(*out)))), schema=packet)

    def judge(batches):
        for _, rows in _grouped(batches, "shard"):
            out = [(r["frame"], m) for r, m in zip(rows, judged(rows, length)) if m]
            if out:
                yield pa.RecordBatch.from_pydict({"frame": pa.array([f for f, _ in out], pa.int64()), "marks": pa.array([m for _, m in out], pa.binary())})

    def apply(batches):
        for f, rows in _grouped(batches, "frame"):
            frame = _load(uri, f)
            marks = np.frombuffer(b"".join(r["marks"] for r in rows if r["marks"]), "<u4").reshape(-1, 3).astype(np.int64)
            n = len(frame.buf)
            depth = np.bincount(frame.off[marks[:, 0]] + marks[:, 1], minlength=n + 1) - np.bincount(frame.off[marks[:, 0]] + marks[:, 2], minlength=n + 1)
            yield finish(frame, np.cumsum(depth)[:n] > 0)

    sent = answers.repartition(tasks, "frame").sortWithinPartitions("frame").mapInArrow(lean(texts), "shard int, frame long, text binary, lens binary, key binary, n binary, doc binary, pos binary, id binary")
    marks = saved(sent.repartitionById(text_shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(lean(judge), "frame long, marks binary"), "marks")
    return marks.union(frames.select("frame", F.lit(b"").alias("marks"))).repartition(tasks, "frame").sortWithinPartitions("frame").mapInArrow(lean(apply), schema)


def judged(rows: list[dict], length: int) -> list[bytes]:
    """For each packet of one shard the intervals to remove: (document, first byte, end) as u32.

    Equal strings stand under equal keys. So a text that is the only one of its key has none of another text: what it has first, all
    of it has. The suffix array is over the others. A key is 32 bits; two that are equal by chance only bring their texts together.
    """
    unique: dict[bytes, int] = {}
    where, ids, keys = [], [], []
    for r in rows:
        at, own = 0, []
        for n, key in zip(np.frombuffer(r["lens"], "<u4").tolist(), np.frombuffer(r["key"], "<u4").tolist()):
            t = r["text"][at : at + n]
            k = unique.setdefault(t, len(unique))
            if k == len(keys):
                keys.append(key)
            own.append(k)
            at += n
        where.append(np.repeat(np.array(own, np.int64), np.frombuffer(r["n"], "<u4")))
        ids.append(np.frombuffer(r["id"], "<i8"))
    least = np.full(len(unique), NEVER_SMALLER)
    np.minimum.at(least, np.concatenate(where), np.concatenate(ids))
    _, inverse, counts = np.unique(np.array(keys, np.uint32), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    lens = np.fromiter(map(len, unique), np.int64, len(unique))
    windows = lens - length + 1
    most, fewest, off = least.copy(), least.copy(), np.zeros(len(unique), np.int64)
    if shared.any():
        text = np.frombuffer(b"".join(compress(unique, shared)), np.uint8)
        del unique
        smallest, off[shared], most[shared], fewest[shared] = least_holders(text, lens[shared], least[shared], length)

    out = []
    for r, w, d in zip(rows, where, ids):
        doc, pos = np.frombuffer(r["doc"], "<u4").astype(np.int64), np.frombuffer(r["pos"], "<u4").astype(np.int64)
        whole = d > most[w]
        found = [np.stack([doc[whole], pos[whole], pos[whole] + lens[w[whole]]], 1)]
        mixed = np.flatnonzero(~whole & (d > fewest[w]))
        at = 0
        while at < len(mixed):
            total = np.cumsum(windows[w[mixed[at:]]])
            end = at + max(1, int(np.searchsorted(total, 1 << 20)))
            part = mixed[at:end]
            at = end
            many = windows[w[part]]
            k = np.repeat(part, many)
            step = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
            goes = smallest[off[w[k]] + step] < d[k]
            begin = goes & np.concatenate([[True], ~goes[:-1] | (k[1:] != k[:-1])])
            stop = goes & np.concatenate([~goes[1:] | (k[1:] != k[:-1]), [True]])
            a, z = np.flatnonzero(begin), np.flatnonzero(stop)
            found.append(np.stack([doc[k[a]], pos[k[a]] + step[a], pos[k[a]] + step[z] + length], 1))
        out.append(np.concatenate(found).astype("<u4").tobytes())
    return out


def least_holders(text: np.ndarray, lens: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each position of texts end to end the least id of those that have the string from there, given the least of each text.

    Returns these, where each text starts, and the greatest and least of them within each.
    """
    off = np.cumsum(lens) - lens
    sa = suffix_array(text)
    same = common_prefixes(text, sa) >= length
    sa = sa[1:]
    owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    own = sa + length <= (off + lens)[owner[sa]]  # strings that do not run into the next text
    group = np.cumsum(~same[sa], dtype=np.int32)[own]
    sa = sa[own]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    lowest = np.minimum.reduceat(least[owner[sa]], first)
    smallest = np.full(len(text), NEVER_SMALLER)
    smallest[sa] = np.repeat(lowest, np.diff(np.append(first, len(sa))))
    within = np.arange(len(text)) - off[owner] < (lens - length + 1)[owner]
    most = np.maximum.reduceat(np.where(within, smallest, np.iinfo(np.int64).min), off)
    return smallest, off, most, np.minimum.reduceat(smallest, off)


def _spans(frame: Frame, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes and maximal removed runs of each document."""
    count = np.concatenate([[0], np.cumsum(removed)])
    begins = removed & np.concatenate([[True], ~removed[:-1]]) if len(removed) else removed
    firsts = frame.off[:-1][frame.off[:-1] < frame.off[1:]]
    begins[firsts] = removed[firsts]
    runs = np.concatenate([[0], np.cumsum(begins)])
    return count[frame.off[1:]] - count[frame.off[:-1]], runs[frame.off[1:]] - runs[frame.off[:-1]]


def _kept(frame: Frame, removed: np.ndarray, n: np.ndarray):
    for i, (a, z) in enumerate(zip(frame.off, frame.off[1:])):
        own = frame.buf[a:z]
        yield (own[~removed[a:z]] if n[i] else own).tobytes()


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; null and empty texts have no bytes. See remove_repeats."""

    def finish(frame: Frame, removed: np.ndarray) -> pa.RecordBatch:
        n, runs = _spans(frame, removed)
        return pa.RecordBatch.from_arrays([frame.table.column("doc_id").combine_chunks(), pa.array(np.diff(frame.off)), pa.array(n.astype(np.int64)), pa.array(runs.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in _kept(frame, removed, n)])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the bytes that stay as text; columns, names and types as before, n_chars (if there) counted anew.

    A character of which only some bytes stay is dropped whole. Rows that lose everything go.
    """
    columns = docs.columns
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])

    def finish(frame: Frame, removed: np.ndarray) -> pa.RecordBatch:
        n, _ = _spans(frame, removed)
        texts = [t.decode("utf-8", "ignore") for t in _kept(frame, removed, n)]
        table = frame.table
        texts = [None if old is None else t for t, old in zip(texts, table.column("text").to_pylist())]
        stays = pa.array((n == 0) | np.array([bool(t) for t in texts]))
        for name, values in (("text", texts), ("n_chars", [None if t is None else len(t) for t in texts])):
            if name in columns:
                k = table.schema.get_field_index(name)
                changed = n > 0
                old = table.column(k).to_pylist()
                table = table.set_column(k, table.schema.field(k), pa.array([v if c else o for v, c, o in zip(values, changed, old)], table.schema.field(k).type))
        table = table.filter(stays).combine_chunks()
        return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)

    return remove_repeats(docs, finish, schema, length)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm.common import table

    return digests(table(spark, sf_dir, "documents"))
