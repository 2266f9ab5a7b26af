"""Token ids as binary files: independent zstandard frames, a trailing seek table and per-frame checksums.

Layout of a file (little-endian throughout):
- data frames: each an independent zstandard frame whose content is
  n u32 | n valid u8 | n doc_id i64 | n length u64 | ids u32;
- one index frame: per data frame first doc_id i64, last doc_id i64, first token i64, first document i64;
- a skippable frame (magic 0x184D2A5E) with the seek table: per frame compressed size u32, decompressed size u32,
  low 32 bits of the content's XXH64; then number of frames u32, descriptor u8 (0x80: checksums), magic 0x8F92EAB1.
This is the public seekable format of zstandard, so its readers open the files too.

Documents are in ascending doc_id (null ids first, ties by a hash of the text) within a file and from file to file.
A null or empty text has the end id only; a text is encoded whole, however long, and is never parted between frames. Repeated
rows are written once each. Other columns are ignored, whatever their names. Files are named by their partition and put in
place by a rename, so that a task that runs twice leaves the same one file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataline.llm.common import lean, parts_for, scratch, text_bytes, text_slices, tokenizer_encoder

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_TOKENS = 1 << 16


def filesystem(uri: str):
    """pyarrow's file system and path of a URI; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def put_in_place(fs, own: str, path: str):
    """A finished file gets its name; if another attempt of the task has given it one already, that file stays."""
    try:
        fs.move(own, path)
    except OSError:
        if not fs.get_file_info(path).is_file:
            raise
        fs.delete_file(own)


class FrameWriter:
    """Frames into an open binary stream."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.zstd, self.table, self.index, self.tokens, self.docs = out, zstandard.ZstdCompressor(level=level, write_checksum=True), [], [], 0, 0

    @property
    def frames_written(self) -> int:
        return len(self.table)

    def content(self, content: bytes):
        """One frame of any content."""
        import xxhash

        packed = self.zstd.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def add(self, doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray):
        keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
        valid = np.array([d is not None for d in doc_ids], "u1")
        self.content(struct.pack("<I", len(keys)) + valid.tobytes() + keys.tobytes() + lens.astype("<u8").tobytes() + ids.astype("<u4").tobytes())
        known = keys[valid == 1]
        self.index.append((int(known[0]), int(known[-1])) + (self.tokens, self.docs) if len(known) else (0, -1, self.tokens, self.docs))
        self.tokens += int(lens.sum())
        self.docs += len(keys)

    def close(self):
        self.content(np.array(self.index, "<i8").tobytes())
        table = b"".join(struct.pack("<III", *t) for t in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Documents of one file; decompresses only the frames asked for and checks each against its checksum."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise ValueError(f"{uri}: no seek table at its end")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.uri, self.table = uri, table
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        self.index = np.frombuffer(self.content(n - 1), "<i8").reshape(-1, 4)

    def content(self, k: int) -> bytes:
        import xxhash
        import zstandard

        packed, plain, check = (int(x) for x in self.table[k])
        content = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, int(self.offsets[k])), max_output_size=plain)
        if len(content) != plain or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.uri}: frame {k} does not match its checksum")
        return content

    def frame(self, k: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """(doc_ids, lengths, ids) of one data frame."""
        content = self.content(k)
        n = struct.unpack_from("<I", content)[0]
        valid = np.frombuffer(content, "u1", n, 4)
        keys = np.frombuffer(content, "<i8", n, 4 + n)
        lens = np.frombuffer(content, "<u8", n, 4 + 9 * n).astype(np.int64)
        return [int(d) if v else None for d, v in zip(keys, valid)], lens, np.frombuffer(content, "<u4", -1, 4 + 17 * n)

    def frames(self):
        return (self.frame(k) for k in range(len(self.index)))

    def document(self, doc_id: int) -> np.ndarray | None:
        """The ids of one document (of the first, if its id occurs again), or None."""
        for k in np.flatnonzero((self.index[:, 0] <= doc_id) & (self.index[:, 1] >= doc_id)):
            keys, lens, ids = self.frame(int(k))
            if doc_id in keys:
                i = keys.index(doc_id)
                at = int(lens[:i].sum())
                return ids[at : at + int(lens[i])]
        return None


def write_token_files(docs: DataFrame, tokenizer_path: str, uri: str, end_id: int = 1, spaces: bool = False, part_bytes: int = 24 << 20) -> DataFrame:
    """Encode docs (doc_id, text) and write one file for each range of doc_id; returns the manifest.

    Manifest: file int (ascending with doc_id), path, n_docs, n_tokens. A table without rows gives no file.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts_for(spark, text_bytes(docs), part_bytes)

    def write(batches):
        from pyspark import TaskContext

        enc = tokenizer_encoder(tokenizer_path, spaces)
        part = TaskContext.get().partitionId()
        name = f"{uri.rstrip('/')}/part-{part:06d}.tokens"
        out = None
        keys, lens, ids = [], [], []

        def flush():
            if keys:
                writer.add(keys, np.concatenate(lens), np.concatenate(ids))
            keys.clear(), lens.clear(), ids.clear()

        held = 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for i, j, texts in text_slices(b, 1):
                if out is None:
                    fs, path = filesystem(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    own = f"{path}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(own)
                    writer = FrameWriter(out)
                flat, n_ids = enc.encode(texts)
                ends = np.cumsum(n_ids)
                flat = np.insert(flat, ends, end_id)  # after each document
                n_ids = n_ids + 1
                tops = np.concatenate([[0], np.cumsum(n_ids)])
                k = i
                while k < j:
                    m = k
                    while m < j and (held < FRAME_TOKENS or m == k and not keys):
                        held += int(n_ids[m - i])
                        m += 1
                    keys.extend(doc_ids[k:m])
                    lens.append(n_ids[k - i : m - i])
                    ids.append(flat[tops[k - i] : tops[m - i]])
                    if held >= FRAME_TOKENS:
                        flush()
                        held = 0
                    k = m
        if out is not None:
            flush()
            writer.close()
            out.close()
            put_in_place(fs, own, path)
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "path": [name], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    made = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(lean(write), "file int, path string, n_docs long, n_tokens long")
    manifest = f"{uri.rstrip('/')}/manifest"
    made.write.parquet(manifest)
    return spark.read.schema(made.schema).parquet(manifest)


def read_token_files(spark: SparkSession, manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Every document of the files of a manifest, each file by one task, frame by frame.

    doc_id, start (ids before it in all files), n_tokens, ids_crc32 (of the ids as little-endian u32), and ids if asked.
    """
    listed = manifest.select("file", "path", "n_tokens", (F.col("file") / 1024).cast("int").alias("block"))
    # ids before a file: those of its block of 1024 files, and of the blocks before, a row each
    blocks = listed.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("file")) - F.col("n_tokens")
    listed = listed.withColumn("inside", inside).join(blocks, "block").select("file", "path", (F.col("before") + F.col("inside")).alias("start"))
    n = manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def read(batches):
        for b in batches:
            for path, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for keys, lens, flat in FrameReader(path).frames():
                    tops = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
                    raw = memoryview(flat.tobytes())
                    out = {"doc_id": pa.array(keys, pa.int64()), "start": tops[:-1] + at, "n_tokens": lens, "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(tops, tops[1:])], pa.int64())}
                    if ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(tops, pa.int32()), pa.array(flat.astype(np.int64)))
                    at += int(tops[-1])
                    yield pa.RecordBatch.from_pydict(out)

    return listed.repartition(max(1, n), "file").mapInArrow(lean(read), schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strataline.llm.common import table

    uri = scratch(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), uri)
    return read_token_files(spark, manifest)
