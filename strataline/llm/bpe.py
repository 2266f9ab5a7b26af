"""Byte-level BPE by ranks, for texts of any length, and its decoding.

Merging works on a hierarchical-bitmap rank queue over all new pre-tokens of a batch, laid out one behind another as one
linked list that is cut between them. Each rank at which two neighbours could merge has a bucket of the list positions
where they meet. A lower bitmap says which of 256 ranks in a row have a bucket with any, an upper one in which of these rows
anything waits: find-first-set in the upper and then in the lower gives the least rank. A bucket's positions are taken
together; those whose pair has changed since they were put in are stale and skipped, and of positions that share a part
the leftmost goes first. Each merge adds at most two entries, so the work is in proportion to the bytes, whether they
are many short pre-tokens or a single very long one.

All positions of a rank may be taken at once only if no pair that they make has a lower rank. For the few ranks where one may,
only the leftmost position of each pre-token is taken, and the others wait in their bucket.

Texts are cut where the pattern always begins a pre-token; the ids of a chunk are kept for the next time it comes.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import ChunkCache, chunk_text, gathered, lean, text_slices

ROW = 256  # ranks to a lower bitmap


class RankBPE(ChunkCache):
    """Encoder and decoder of one vocabulary of byte strings by rank."""

    def __init__(self, path: str, pattern: str, max_entries: int = 1_000_000):
        import regex

        super().__init__(True, max_entries)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.size = max(self.ranks.values()) + 1
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        whole = [b""] * self.size
        for b, r in self.ranks.items():
            whole[r] = b
        self.bytes_flat = np.frombuffer(b"".join(whole), np.uint8)
        self.bytes_lens = np.array([*map(len, whole)], np.int64)
        self.bytes_starts = np.cumsum(self.bytes_lens) - self.bytes_lens
        digits = [f"{r},".encode() for r in range(self.size)]
        self.digits = np.array(digits, f"S{max(map(len, digits))}")  # shorter ones end in zero bytes
        self.digits_lens = np.array([*map(len, digits)], np.int64)
        # every pair of ids whose bytes together are a token, by first * size + second, and the token's rank
        get = self.ranks.get
        pairs = [(x * self.size + y, r) for b, r in self.ranks.items() for k in range(1, len(b)) if (x := get(b[:k])) is not None and (y := get(b[k:])) is not None]
        self.pair_keys, ranks = (np.array(c, np.int64) for c in zip(*sorted(pairs)))
        self.pair_ranks = ranks.astype(np.int32)
        self.lowers = np.zeros(self.size, bool)  # ranks whose token is in a pair of a lower rank
        for part in (self.pair_keys // self.size, self.pair_keys % self.size):
            self.lowers[part[ranks < part]] = True

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where there is none."""
        q = a.astype(np.int64) * self.size + b
        at = np.searchsorted(self.pair_keys, q)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == q, self.pair_ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens (none empty) one after another, and how many each has."""
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(buf)
        lens = np.array([*map(len, pieces)], np.int64)
        starts = np.cumsum(lens) - lens
        cut = np.zeros(n + 1, bool)  # a pre-token begins here
        cut[starts] = True
        cut[n] = True
        ids = np.append(self.of_byte[buf], np.int32(0))
        end, before, alive = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n, bool)
        rank = np.full(n + 1, -1, np.int32)  # of the part that begins here with the next one; -1: none
        meet = np.flatnonzero(~cut[1:n])
        rank[meet] = self._rank(ids[meet], ids[meet + 1])
        upper, rows = 0, {}  # bit h: something waits in row h; rows[h]: arrays of positions that came with a rank in it
        lower, buckets = 0, {}  # of the row that is being done: bit k and positions of each rank

        def groups(at: np.ndarray, by: np.ndarray):
            if len(at) == 1:
                return [(int(by[0]), at)]
            order = np.argsort(by, kind="stable")
            at, by = at[order], by[order]
            edges = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1], [True]])).tolist()
            return [(k, at[a:z]) for a, z, k in zip(edges, edges[1:], by[edges[:-1]].tolist())]

        def wait(at: np.ndarray):
            nonlocal upper
            for h, own in groups(at, rank[at] // ROW):
                rows.setdefault(h, []).append(own)
                upper |= 1 << h

        def put(at: np.ndarray):
            nonlocal lower
            for r, own in groups(at, rank[at]):
                buckets.setdefault(r, []).append(own)
                lower |= 1 << r % ROW

        if len(first := np.flatnonzero(rank >= 0)):
            wait(first)
        while upper:
            h = (upper & -upper).bit_length() - 1
            upper ^= 1 << h
            held = np.concatenate(rows.pop(h))
            if len(held := held[rank[held] // ROW == h]):
                put(held)
            later: list[np.ndarray] = []  # new entries of other rows, put there when this one is done
            while lower:
                r = h * ROW + (lower & -lower).bit_length() - 1
                lower &= lower - 1
                at = buckets.pop(r)
                at = np.concatenate(at) if len(at) > 1 else at[0]
                at = at[rank[at] == r]  # the others are stale: one of their two parts has grown or gone
                if not len(at):
                    continue
                if len(at) > 1:
                    at = np.unique(at)
                    if self.lowers[r]:
                        own = np.searchsorted(starts, at, "right")
                        leftmost = np.concatenate([[True], own[1:] != own[:-1]])
                        if not leftmost.all():
                            put(at[~leftmost])
                        at = at[leftmost]
                    else:
                        at = self._apart(at, end)
                mid = end[at]
                z = end[mid]
                end[at], ids[at], alive[mid], rank[mid] = z, r, False, -1
                more = ~cut[z]
                before[z[more]] = at[more]
                # the merged part with the next one, then the one before with it
                rank[at] = np.where(more, self._rank(ids[at], ids[z]), -1)
                prev = before[at[~cut[at]]]
                rank[prev] = self._rank(ids[prev], ids[end[prev]])
                new = np.concatenate([at, prev])
                new = new[rank[new] >= 0]
                if not len(new):
                    continue
                row = rank[new] // ROW
                here = row == h
                if here.any():
                    put(new[here])
                    new, row = new[~here], row[~here]
                if len(new):
                    later.append(new)
                    if self.lowers[r] and (row < h).any():  # back to an earlier row; what is left of this one waits
                        later += [x for k in buckets.values() for x in k]
                        lower = 0
                        buckets.clear()
            if later and len(at := (at := np.concatenate(later))[rank[at] >= 0]):
                wait(at)
        return ids[:n][alive].astype(np.uint32), np.add.reduceat(alive, starts, dtype=np.int64)

    @staticmethod
    def _apart(at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of positions in order, in each run that shares parts, the first, third and so on."""
        joined = end[at[:-1]] == at[1:]
        if not joined.any():
            return at
        k = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), k, 0))
        return at[(k - run) % 2 == 0]

    def _add(self, words: list[str]):
        pieces: dict[bytes, int] = {}
        own, counts = [], []  # numbers of each chunk's pre-tokens
        number = pieces.setdefault
        for c in words:
            if c.isalpha():  # letters behind one blank are one pre-token
                own.append(number(b" " + c.encode(), len(pieces)))
                counts.append(1)
            else:
                found = self.split(chunk_text(c))
                own += [number(p.encode(), len(pieces)) for p in found]
                counts.append(len(found))
        listed, get = list(pieces), self.ranks.get
        whole = np.array([get(p, -1) for p in listed], np.int64)
        rest = np.flatnonzero(whole < 0)
        many = np.ones(len(listed), np.int64)
        ids = np.zeros(0, np.uint32)
        if len(rest):
            ids, many[rest] = self.merge([listed[i] for i in rest.tolist()])
        flat = np.zeros(int(many.sum()), np.uint32)
        known = np.repeat(whole >= 0, many)
        flat[known], flat[~known] = whole[whole >= 0], ids
        flat, lens = gathered(flat, np.cumsum(many) - many, many, np.array(own, np.int64))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self._keep(words, flat, np.diff(np.concatenate([[0], np.cumsum(lens)])[bounds]))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after another, and how many each has."""
        return gathered(self.bytes_flat, self.bytes_starts, self.bytes_lens, ids)

    def as_text(self, ids: np.ndarray) -> bytes:
        """Decimal ids, each with a comma behind it."""
        return self.digits[ids].tobytes().translate(None, b"\0")


_own: dict[tuple, RankBPE] = {}


def rank_bpe(path: str, pattern: str) -> RankBPE:
    """One for each Python worker."""
    if (path, pattern) not in _own:
        _own[path, pattern] = RankBPE(path, pattern)
    return _own[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and decoded of each row's whole text.

    No row needs another: a map over the scan, without a shuffle. A null or empty text has no ids. Repeated rows are encoded
    each for itself, so there are no ties; other columns are ignored; a table without rows gives none. A text is encoded
    whole, however long it or a word in it is.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int64())), ("decoded", pa.binary())] * ids)

    def work(batches):
        own = rank_bpe(path, pattern)
        tops = lambda n: np.concatenate([[0], np.cumsum(n)])
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for b in batches:
            for i, j, texts in text_slices(b, 1, 4_000_000):
                flat, n = own.encode(texts)
                ends = tops(n)
                written, digits = memoryview(own.as_text(flat)), tops(own.digits_lens[flat])[ends].tolist()
                back, lens = own.decode(flat)
                raw, cuts = memoryview(back), tops(lens)[ends].tolist()
                out = [b.column(0)[i:j], pa.array(n), pa.array([sha(written[a : max(a, z - 1)]) for a, z in zip(digits, digits[1:])], pa.string()), pa.array([sha(raw[a:z]) for a, z in zip(cuts, cuts[1:])], pa.string())]
                if ids:
                    out += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64))), pa.array([bytes(raw[a:z]) for a, z in zip(cuts, cuts[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, schema=arrow)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(work), schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strataline.llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
