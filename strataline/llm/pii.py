"""Personal data: exact patterns, and identifiers of other forms found by bootstrapped contexts.

1. Base spans come from fixed patterns with their checks (parts of an address, Luhn, number of digits).
2. Seeds: distinct values of base spans. Candidates: looser shapes that no base span covers - groups of digits, addresses with `@`, `(at)`,
   `[dot]` or words for them, dotted quads with parts above 255, card numbers whose check digit fails.
3. A pattern is the one, two or three words before an identifier. The graph of patterns and values is scored in rounds: a pattern's
   confidence for a kind is the score of the distinct values it introduces over that, a share of the unknown ones that it introduces, and all its
   other occurrences in the corpus; a value's score is the best confidence of its patterns, seeds have 1. A round's accepted
   values support further patterns. Rounds end when no value is accepted any more.
4. A candidate whose value is accepted becomes a span of that kind.

Only distinct values count, so copies and hot sources add nothing. Word sequences are counted only where a Bloom filter of bounded
size lets them pass, and exactly behind it. Nothing but the filter comes to the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import lean, saved, table, text_slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only begin where a run of digits does, so no start is tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++")
_AT = re.compile(r"\s?[\[(]\s?at\s?[\])]\s?|\s?@\s?|\sat\s", re.I)
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[A-Za-z0-9-]++)*", re.I)
_DOT = re.compile(r"\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s", re.I)
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
EDGES = ".,;:!?()[]{}<>\"'*#&%$|=_-"
BLOOM_BITS = 1 << 23  # one MB; false hits only cost rows that the exact count drops


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind; leftmost and non-overlapping within a kind, failing matches dropped."""
    out, end, last, at = [], 0, -1, t.find("@")
    while at >= 0:
        # the local part is all that can stand directly before the sign
        local = t[max(end, last + 1) : at]
        start = at - (len(local) - len(local.rstrip(LOCAL)))
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            end = m.end()
            out.append((start, end, 0))
        last, at = at, t.find("@", max(end, at + 1))
    out += [(*m.span(), 1) for m in _IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in _CARD.finditer(t) if m.end() - m.start() > 11 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in t:
        out += [(*m.span(), 3) for m in _PHONE.finditer(t) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def value_of(s: str, kind: int) -> str:
    """What makes two spellings the same identifier."""
    if kind == 0:
        return _DOT.sub(".", _AT.sub("@", s)).lower()
    return s if kind == 1 else digits_of(s)


def candidates(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, bits of the kinds it may be) of looser shapes that touch no base span."""
    found = []
    low = t.lower()
    if "@" in t or "at" in low and "dot" in low or "(at" in low or "[at" in low:
        lo = 0
        for m in _AT.finditer(t):
            k = m.start()
            start = k
            while start > lo and t[start - 1] in LOCAL:
                start -= 1
            d = _LOOSE_DOMAIN.match(t, m.end())
            if start < k and d and ("@" in m[0] or "." in (plain := _DOT.sub(".", d[0])) and (m[0].strip().lower() != "at" or plain != d[0])):
                lo = d.end()
                found.append((start, lo, 1))
    for m in _DIGITS.finditer(t):
        if m.end() - m.start() > 6:
            n = len(digits_of(m[0]))
            bits = 2 if _QUAD.fullmatch(m[0]) else (4 if 12 <= n <= 19 else 0) | (8 if 7 <= n <= 15 else 0)
            if bits:
                found.append((*m.span(), bits))
    ends = sorted((s, e) for s, e, _ in base)
    out, k, taken = [], 0, 0
    for s, e, bits in sorted(found):
        while k < len(ends) and ends[k][1] <= s:
            k += 1
        near = ends[k : k + 4]
        if s >= taken and not any(a < e and s < b for a, b in near):
            out.append((s, e, bits))
            taken = e
    return out


def plain_word(w: str) -> str:
    return w.strip(EDGES).lower()


def words_before(t: str, start: int, most: int = 3) -> list[str]:
    """Up to most words (without marks, in lower case) directly before start, the nearest last."""
    size = 64
    while True:
        lo = max(0, start - size)
        own = t[lo:start].split()
        if lo and not t[lo - 1].isspace() and own and not t[lo].isspace():
            own = own[1:]
        own = [w for w in map(plain_word, own) if w]
        if len(own) >= most or not lo:
            return own[-most:]
        size *= 4


def _hash(w: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Keys of sequences of words from the hashes of the words."""
    key = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        key = (key ^ p) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def pattern_keys(words: list[str]) -> list[int]:
    """Keys of the last one, two and three words."""
    h = [np.array([_hash(w)], np.uint64) for w in words]
    return [int(_joined(h[-n:]).view(np.int64)[0]) for n in range(1, len(h) + 1)]


SPANS = "array<struct<start:int,end:int,kind:int>>"
CANDIDATES = "array<struct<start:int,end:int,bits:int,value:bigint,keys:array<bigint>>>"


def _scanned(docs: DataFrame) -> DataFrame:
    """id (of the row), doc_id, base spans and candidates (base ones too, with bits 16 << kind) of every row."""
    import xxhash

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.int32()), ("value", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    def row(t: str, s: int, e: int, bits: int, kind: int) -> dict:
        v = xxhash.xxh64_intdigest(f"{min(kind, 1) if kind != 1 else 2}:{value_of(t[s:e], kind)}".encode("utf-8", "surrogatepass"), 9)
        return {"start": s, "end": e, "bits": bits, "value": v - (1 << 64) * (v >> 63), "keys": pattern_keys(words_before(t, s))}

    def work(batches):
        for b in batches:
            for i, j, texts in text_slices(b, 1, 1_000_000):
                base = [base_spans(t) for t in texts]
                more = [[row(t, s, e, 16 << k, k) for s, e, k in own] + [row(t, s, e, bits, {1: 0, 2: 1}.get(bits, 2)) for s, e, bits in candidates(t, own)] for t, own in zip(texts, base)]
                spans = [[{"start": s, "end": e, "kind": k} for s, e, k in own] for own in base]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(spans, span), pa.array(more, cand)], names=["doc_id", "base", "found"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), f"doc_id long, base {SPANS}, found {CANDIDATES}")
    return saved(made.withColumn("id", F.monotonically_increasing_id()), "found")


def _bloom(keys: DataFrame) -> np.ndarray:
    """Bits of the keys, three each; a row of a MB at most comes from each task."""

    def work(batches):
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            k = b.column(0).to_numpy().view(np.uint64)
            for r in (3, 19, 37):
                bits[(k >> np.uint64(r)) % np.uint64(BLOOM_BITS)] = True
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["w", "bit"])

    rows = keys.mapInArrow(work, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    words[rows["w"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return np.unpackbits(words.view("u1"), bitorder="little").astype(bool)


def _counted(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key and n: how often each sequence of words of keys stands in all texts."""
    bits = np.packbits(_bloom(keys))

    def merged(held, counts):
        key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        every, at = np.unique(np.concatenate([counts[0], key]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate([counts[1], n]))
        return [], (every, total)

    def work(batches):
        bloom = np.unpackbits(bits).astype(bool)
        held, counts, size = [], (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0  # a row a task and sequence
        for b in batches:
            for _, _, texts in text_slices(b, 0, 1_000_000):
                words = [w for t in texts for w in [*t.split(), "\n"]]
                enc = pa.array(words, pa.large_string()).dictionary_encode()
                names = [plain_word(w) if w != "\n" else "\n" for w in enc.dictionary.to_pylist()]
                h = np.array([_hash(w) for w in names], np.uint64)
                code = enc.indices.to_numpy()
                use = np.array([w != "" for w in names])[code]
                ends = np.array([w == "\n" for w in names])[code][use]
                own = h[code[use]]
                out = []
                for n in range(1, 4):
                    if len(own) >= n:
                        part = [own[k : len(own) - n + 1 + k] for k in range(n)]
                        inside = ~np.logical_or.reduce([ends[k : len(own) - n + 1 + k] for k in range(n)])
                        key = _joined(part)[inside]
                        hit = np.logical_and.reduce([bloom[(key >> np.uint64(r)) % np.uint64(BLOOM_BITS)] for r in (3, 19, 37)])
                        out.append(key[hit])
                held += out
                if (size := size + sum(map(len, out))) > 1 << 20:
                    held, counts = merged(held, counts)
                    size = 0
        key, n = merged(held, counts)[1]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(lean(work), "key long, n long").join(keys, "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))


def personal_data(docs: DataFrame, support: float = 5.0, confidence: float = 0.7, unknown: float = 0.2) -> DataFrame:
    """doc_id, base and spans (start, end, kind number in KINDS; code points, end exclusive; by start, then kind) of every row of docs.

    base are the spans of the fixed patterns, spans those and what the method adds. A pattern needs values of at least `support`
    together, and `confidence`; `unknown` is the share at which values not known to be of a kind count against it. Null, empty
    and blank texts have no spans; texts are taken whole, however long. Repeated rows and rows without doc_id give a row
    each; other columns are ignored, whatever their names; a table without rows gives none.
    """
    found = _scanned(docs)
    each = found.select("id", F.explode("found").alias("c")).select("id", "c.*")
    # a value is a seed of the kinds of its base spans; its candidates say what it may be
    values = saved(each.groupBy("value").agg(F.bit_or(F.col("bits").bitwiseAND(15)).alias("may"), F.bit_or(F.shiftright("bits", 4)).alias("seed")), "values")
    edges = saved(each.select(F.explode("keys").alias("key"), "value").groupBy("key", "value").agg(F.count("*").alias("m")), "edges")
    graph = edges.join(values, "value")
    bit = lambda c: F.expr(f"({c} & shiftleft(1, kind)) != 0")
    kinds = F.explode(F.array(*map(F.lit, range(len(KINDS))))).alias("kind")
    # what a pattern would need if all values that may be of the kind were, and it stood nowhere else
    of = lambda c: F.sum(F.when(c, 1).otherwise(0))
    could = graph.select("*", kinds).groupBy("key", "kind").agg(of(bit("seed")).alias("seeds"), of(bit("seed") | bit("may") & (F.col("seed") == 0)).alias("pro"), F.count("*").alias("s"))
    supported = could.where(f"seeds >= 1 and pro >= {support} and pro / (s + 1) >= {confidence}").select("key").distinct()
    keys = saved(supported.select("key"), "patterns")
    accepted = found.sparkSession.createDataFrame([], "value long, kind int, score double")
    if not keys.isEmpty():
        every = saved(edges.groupBy("key").agg(F.sum("m").alias("m")).join(_counted(docs, keys), "key").select("key", F.greatest(F.lit(0), F.col("n") - F.col("m")).alias("others")), "counts")
        graph = saved(graph.join(keys, "key", "left_semi").select("key", "value", "may", "seed"), "graph")
        all_kinds = graph.select("*", kinds)
        known = -1
        while True:
            scored = all_kinds.join(accepted, ["value", "kind"], "left").withColumn("s", F.when(bit("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
            against = F.when(bit("may") & (F.col("seed") == 0), unknown * (1 - F.col("s"))).otherwise(1 - F.col("s"))
            conf = scored.groupBy("key", "kind").agg(F.sum("s").alias("pro"), F.sum(against).alias("con"), F.sum(F.when(bit("seed"), 1).otherwise(0)).alias("seeds")).where(f"seeds >= 1 and pro >= {support}")
            conf = conf.join(every, "key").withColumn("c", F.round(F.col("pro") / (F.col("pro") + F.col("con") + F.col("others") + 1), 9)).where(F.col("c") >= confidence)
            reached = all_kinds.where(bit("may") & (F.col("seed") == 0)).join(conf.select("key", "kind", "c"), ["key", "kind"])
            now = reached.groupBy("value", "kind").agg(F.max("c").alias("score"))
            # what was accepted stays, at its best score, so the rounds end
            accepted = saved(accepted.union(now).groupBy("value", "kind").agg(F.max("score").alias("score")), "accepted")
            if (n := accepted.count()) == known:
                break
            known = n
    direct = values.where("seed > 0 and may > 0").select("value", F.expr("case when seed & 1 != 0 and may & 1 != 0 then 0 when seed & 2 != 0 and may & 2 != 0 then 1 when seed & 4 != 0 and may & 4 != 0 then 2 when seed & 8 != 0 and may & 8 != 0 then 3 end").alias("kind"), F.lit(1.0).alias("score")).where("kind is not null")
    best = accepted.union(direct).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select("value", (-F.col("b.k")).alias("kind"))
    new = each.where("bits < 16").join(best, "value").where("(bits & shiftleft(1, kind)) != 0")
    more = new.groupBy("id").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))
    whole = found.select("id", "doc_id", "base").join(more, "id", "left")
    order = F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(SPANS))), lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return whole.select("doc_id", "base", F.transform(order, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def written(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and base_sha256 are of the base spans; n_added counts what the method adds."""
    found = personal_data(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(n, range(len(KINDS))), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
