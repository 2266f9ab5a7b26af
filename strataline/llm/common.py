"""What the training-data operators share: scratch space, sizing, row keys and cached encoding."""

from __future__ import annotations

import ctypes
import math
import re
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.scratch import saved, scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows (one small aggregate to the driver)."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def parts_for(spark: SparkSession, amount: float, each: float) -> int:
    """As many partitions as amount needs at `each` a partition; at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / each))


_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
RAW = "\0"
MARKS = tuple(".,;:!?")


def space_chunks(t: str) -> list[str]:
    """A text cut where byte-level patterns always begin a token; the ids of the text are those of its chunks in order."""
    if not t:
        return []
    if RAW in t:
        return [RAW + t]
    if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or (any(c in t for c in _ASCII_SPACE) if t.isascii() else _OTHER_SPACE.search(t)):
        w = _BEFORE_WORD.split(t)
        return [RAW + w[0], *(x[1:] for x in w[1:])]
    return (RAW + t.replace("\n", " \0\n \0")).split(" ")


def chunk_text(chunk: str) -> str:
    return chunk[1:] if chunk.startswith(RAW) else " " + chunk


def gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands in flat for each code, one after another, and how much each has."""
    lens = lens[codes]
    ends = np.cumsum(lens)
    return flat[np.repeat(starts[codes] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)], lens


class ChunkCache:
    """Token ids of whole texts, each distinct chunk encoded once.

    Chunks end where no token can cross:
    - words: at blanks and line feeds, which the tokenizer drops (its pre-tokens hold no white space);
    - spaces: before a single blank and around a single line feed that have no other white space beside them, where
      byte-level patterns always begin a token. A chunk stands without its blank; RAW marks those that have none.
    When the cache holds max_entries, the half of them that came most often stays, of those that came again at all.
    """

    def __init__(self, spaces: bool, max_entries: int):
        self.spaces, self.max_entries = spaces, max_entries
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.starts, self.lens, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _shrink(self):
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.max_entries // 2:
            keep = keep[np.argsort(-self.used[keep], kind="stable")[: self.max_entries // 2]]
        flat, lens = self._gather(keep)
        if len(flat) > 4 * self.max_entries:  # a few very long ones
            keep = flat = lens = keep[:0]
        place = np.full(len(self.lens), -1)
        place[keep] = np.arange(len(keep))
        at = {w: k for w, k in zip(self.at, place[np.fromiter(self.at.values(), np.int64, len(self.at))].tolist()) if k >= 0}
        self._clear()
        self.at, self.lens, self.flat = at, lens.astype(np.int64), flat.astype(np.uint32)
        self.starts, self.used = np.cumsum(self.lens) - self.lens, np.ones(len(self.lens), np.int64)

    def _add(self, words: list[str]):
        """Encode new chunks and _keep them."""
        raise NotImplementedError

    def _keep(self, words: list[str], flat: np.ndarray, lens: np.ndarray):
        base, n = len(self.flat), len(self.lens)
        self.starts = np.concatenate([self.starts, base + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, flat])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.at.update(zip(words, range(n, n + len(words))))

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self.flat, self.starts, self.lens, codes)

    def _chunks(self, t: str) -> list[str]:
        return space_chunks(t) if self.spaces else [w for w in t.replace("\n", " ").split(" ") if w]

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after another, and the number of ids of each text."""
        if len(self.at) > self.max_entries or len(self.flat) > 8 * self.max_entries:
            self._shrink()
        words: list[str] = []
        counts = []
        for t in texts:
            w = self._chunks(t)
            words += w
            counts.append(len(w))
        codes = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(codes < 0)
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            self._add(list(dict.fromkeys(unknown)))
            codes[new] = list(map(self.at.__getitem__, unknown))
        self.used += np.bincount(codes, minlength=len(self.used))
        ids, lens = self._gather(codes)
        ends = np.cumsum(lens)
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        tops = np.concatenate([[0], ends]).astype(np.int64)
        return ids, np.diff(tops[bounds])


class ChunkEncoder(ChunkCache):
    """Chunks encoded by a tokenizers object, with the ids of its plain call on the whole texts.

    New chunks are encoded many at a time as one text, where the ids show each chunk's end; the rest one by one. A text that
    holds the beginning of an added token's string goes to the tokenizer whole, as such a string may cross chunks.
    """

    def __init__(self, tokenizer, spaces: bool, max_entries: int = 1_000_000):
        super().__init__(spaces, max_entries)
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if spaces else t.endswith("</w>"))]] = True
        self.added = sorted({t.content[:2] for t in tokenizer.get_added_tokens_decoder().values()})

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = list(map(chunk_text, words)) if self.spaces else words
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), lens

    def _together(self, groups: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Groups of chunks that begin (spaces) or end (words) with exactly one marked token each."""
        texts = [" " * self.spaces + " ".join(words) for words in groups]
        out = []
        for words, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(self.edge[ids])
            if len(marks) == len(words):
                bounds = np.append(marks, len(ids)) if self.spaces else np.concatenate([[0], marks + 1])
                out.append((ids, np.diff(bounds)))
            else:
                out.append(self._one_by_one(words))
        return out

    def _add(self, words: list[str]):
        """New chunks; letters before one mark are encoded for themselves, as a token ends between them.

        Where the tokenizer drops white space it normalises too, which can end other letters in a mark of their own.
        """
        marked = [w for w in words if w[-1:] in MARKS and w[:-1].isalpha() and (self.spaces or w.isascii())]
        if marked:
            known = set(marked)
            words = list(dict.fromkeys([w for w in words if w not in known] + [x for w in marked for x in (w[:-1], RAW * self.spaces + w[-1]) if x not in self.at]))
        if self.spaces:
            easy, rest = [w for w in words if w and w.isprintable()], [w for w in words if not (w and w.isprintable())]
        else:
            easy, rest = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        got = self._together([easy[i : i + 256] for i in range(0, len(easy), 256)])
        got += [self._one_by_one(rest[i : i + 10_000]) for i in range(0, len(rest), 10_000)]
        if got:
            self._keep(easy + rest, np.concatenate([f for f, _ in got]), np.concatenate([n for _, n in got]))
        if marked:
            codes = np.array([self.at[x] for w in marked for x in (w[:-1], RAW * self.spaces + w[-1])], np.int64)
            flat, lens = self._gather(codes)
            self._keep(marked, flat, lens[::2] + lens[1::2])

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = list(texts)
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return super().encode(texts)
        ids, n = super().encode([t if i not in set(whole) else "" for i, t in enumerate(texts)])
        own = {i: np.array(e.ids, np.uint32) for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False))}
        tops = np.concatenate([[0], np.cumsum(n)])
        parts = [own[i] if i in own else ids[tops[i] : tops[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.array([*map(len, parts)], np.int64)


_encoders: dict[tuple, ChunkEncoder] = {}


def tokenizer_encoder(path: str, spaces: bool) -> ChunkEncoder:
    """An encoder on a tokenizers file; one per Python worker, so that tasks that follow each other share its cache."""
    if (path, spaces) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _encoders[path, spaces] = ChunkEncoder(Tokenizer.from_file(path), spaces)
    return _encoders[path, spaces]


def text_slices(batch, column: int, max_chars: int = 2_000_000):
    """(first, last, texts) of runs of rows of an Arrow batch of about max_chars bytes together; a null is an empty text."""
    import pyarrow.compute as pc

    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + max_chars, "right")))
        yield i, j, [t or "" for t in texts[i:j].to_pylist()]
        i = j


def lean(work):
    """work, for mapInArrow, that gives freed memory back to the system when a task ends: workers live on through many stages."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
