"""Operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataline.llm import bpe, packing, quality, simhash, suffix_dedup, suffixes, token_counts, token_files
from strataline.llm.common import ChunkEncoder, scratch
from tests.llm import brute


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encode(name, texts):
    t = Tokenizer.from_file(P.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name, spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_like_whole_texts(name, spaces):
    t = Tokenizer.from_file(P.path(name))
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab é'sdt1.,!  \n\t\r\u00a0\u2003\x1c\u0301日\x00İΣ"), rng.integers(0, 60))) for _ in range(3000)]
    texts += ["", " ", "\n", "a\n", "\na", " a", "a ", "a \n b", "a\nb c\n\nd", "I'm we'll DON'T 's", "<|endoftext|> <|startoftext|>"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|endof", "text|>", " ", "\n", "a", "B1", ".", "é"]
    texts += ["".join(rng.choice(special, rng.integers(1, 9))) for _ in range(3000)]
    enc = ChunkEncoder(t, spaces, max_entries=2000)
    for i in range(0, len(texts), 100):
        ids, n = enc.encode(texts[i : i + 100])
        want = [e.ids for e in t.encode_batch(texts[i : i + 100], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [x for w in want for x in w]


def test_token_files(spark, docs, rows, no_docs):
    uri = scratch(spark, "test-tokens")
    manifest = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), uri)
    got = token_files.read_token_files(spark, manifest, ids=True).orderBy("start").collect()
    want = Counter((r[0], tuple(i + [1])) for r, i in zip(rows, encode("word_bpe_49k.json", [r[1] for r in rows])))
    assert Counter((g["doc_id"], tuple(g["ids"])) for g in got) == want
    at = 0
    for g in got:
        assert g["start"] == at and g["n_tokens"] == len(g["ids"]) and g["ids_crc32"] == crc(g["ids"])
        at += g["n_tokens"]
    known = [g["doc_id"] for g in got if g["doc_id"] is not None]
    assert known == sorted(known) and all(g["doc_id"] is None for g in got[: len(got) - len(known)])
    empty = token_files.write_token_files(no_docs, P.path("word_bpe_49k.json"), scratch(spark, "test-none"))
    assert token_files.read_token_files(spark, empty).collect() == []


def test_token_file_reads_only_what_is_asked(tmp_path):
    import xxhash
    import zstandard

    path = str(tmp_path / "a.tokens")
    with open(path, "wb") as f:
        w = token_files.FrameWriter(f)
        for k in range(3):
            w.add([2 * k, 2 * k + 1], np.array([3, 2]), np.arange(5) + 100 * k)
        w.close()
    r = token_files.FrameReader(path)
    assert r.document(3).tolist() == [103, 104] and r.document(4).tolist() == [200, 201, 202] and r.document(9) is None
    raw = bytearray(open(path, "rb").read())
    assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little")
    plain = zstandard.ZstdDecompressor().decompress(bytes(raw[r.offsets[1] : r.offsets[2]]), max_output_size=1 << 20)
    assert xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF == int(r.table[1, 2])
    raw[int(r.offsets[1]) + 20] ^= 1
    open(path, "wb").write(raw)
    r = token_files.FrameReader(path)
    assert r.document(0).tolist() == [0, 1, 2]
    with pytest.raises(Exception):
        r.document(3)


def check_packing(got, rows, window=2048):
    want = Counter()
    by = {}
    for r, i in zip(rows, encode("byte_bpe_50k.json", [r[1] for r in rows])):
        want[(r[0], r[3])] += len(i) + 1
    tokens = Counter()
    sequences = {}
    for g in got:
        assert 0 < g["length"] <= window
        tokens[(g["doc_id"], g["source"])] += g["length"]
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"], g["source"]))
        by.setdefault((g["doc_id"], g["source"], g["doc_tokens"]), []).append(g)
    assert tokens == want
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sequences, by


def test_packing(spark, docs, rows, no_docs):
    path = P.path("byte_bpe_50k.json")
    sequences, by = check_packing(packing.pack(docs, path).collect(), rows)
    assert sum(sum(n for _, n, _ in s) < 2048 for s in sequences.values()) <= 1
    ids = {(r[0], r[3], len(i) + 1): i + [1] for r, i in zip(rows, encode("byte_bpe_50k.json", [r[1] for r in rows])) if r[0] is not None}
    once = Counter((r[0], r[3]) for r in rows)
    for key, pieces in by.items():
        if key in ids and once[key[:2]] == 1:
            pieces = sorted(pieces, key=lambda g: g["start"])
            assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
            assert all(p["ids_crc32"] == crc(ids[key][p["start"] : p["start"] + p["length"]]) for p in pieces)
    assert packing.pack(no_docs, path).collect() == []
    # small windows and many partitions; targets that exhaust a source early
    check_packing(packing.pack(docs, path, window=64, windows=4).collect(), rows, 64)
    weighted, _ = check_packing(packing.pack(docs, path, weights={"src0": 1.0, "src1": 3.0}, window=64, windows=4).collect(), rows, 64)
    first = Counter()
    for k in sorted(weighted)[:5]:
        for _, n, s in weighted[k]:
            first[s] += n
    assert abs(first["src1"] / (first["src0"] + first["src1"]) - 0.75) < 0.05


def test_deficits_carry(spark):
    quota = packing.fill_windows(np.array([1000, 10, 390]), 64)
    assert quota.sum() == 1400 and (quota.sum(1)[:-1] == 64).all()
    drift = np.cumsum(quota, 0) - np.cumsum(quota.sum(1))[:, None] * np.array([1000, 10, 390]) / 1400
    assert np.abs(drift).max() < 2
    plan = packing.Schedule({"a": 5000, "b": 77, None: 3}, None, 64, 4)
    for s, n in (("a", 5000), ("b", 77), (None, 3)):
        cuts = plan.cut(plan.index[s], np.arange(plan.parts + 1))
        assert cuts[0] == 0 and cuts[-1] == n and (np.diff(cuts) >= 0).all()


def test_byte_bpe_like_tiktoken(spark, docs, rows, no_docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, path, P.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t, *_ in rows:
        ids = real.encode_ordinary(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert got == want
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aabbeth éñ\n!?日"), rng.integers(0, 80))) for _ in range(300)]
    texts += ["ab" * 30_000, "a" * 30_001, "".join(rng.choice(list("etaoin"), 30_000)), "", "x"]
    own = bpe.RankBPE(path, P.PATTERN, max_entries=500)
    for group in ([texts], [[s] for s in texts]):  # all new pre-tokens together, and each text's own
        for some in group:
            own._clear()
            ids, n = own.encode(some)
            want = [real.encode_ordinary(s) for s in some]
            assert n.tolist() == [*map(len, want)] and ids.tolist() == [i for w in want for i in w]
            back, _ = own.decode(ids)
            assert back.tobytes() == "".join(some).encode()
    assert bpe.encode_documents(no_docs, path, P.PATTERN).collect() == []


def test_token_counts(spark, docs, rows, no_docs):
    path = P.path("piece_bpe_32k.model")
    scores, byte = token_counts.zipf_pieces(path)
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, path).collect())
    short = [(i, t) for i, t, *_ in rows]
    seen = {}
    count = lambda w: seen.setdefault(w, brute.unigram_tokens("▁" + w, scores, byte) if len(w) < 200 else None)
    small = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "ba": -3.0, "▁a": -2.5}
    trie = token_counts.UnigramTrie(small, -9.0, max_nodes=40)
    for w in ("a", "ab", "ba", "abab", "aé", "日b", "b" * 50):
        assert trie.counts([w, w]) == 2 * brute.unigram_tokens("▁" + w, small, -9.0)
    for i, t in short:
        words = (t or "").split()
        if all(len(w) < 200 for w in words):
            assert got[(i, len(words), sum(map(count, words)))] > 0, (i, t)
    assert sum(got.values()) == len(rows)
    assert token_counts.count_tokens(no_docs, path).collect() == []


def test_simhash(spark, docs, rows, no_docs):
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    want = Counter((r[0], *w) for r, w in zip(rows, brute.simhash_components([(r[0], r[1]) for r in rows])))
    assert got == want
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("large", [2048, 4])
def test_near_fingerprints(large):
    rng = np.random.default_rng(0)
    fps = []
    for b in rng.integers(0, 1 << 63, 30, dtype=np.uint64).tolist():
        for _ in range(40):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << bit
            fps.append(x)
    fps = np.unique(np.array(fps + [0, 1, 3, 7, 15], np.uint64))
    parts = fps.view("u1").reshape(-1, 8).astype(np.int64)
    keys = np.concatenate([k << 24 | parts[:, a] << 16 | parts[:, b] << 8 | parts[:, c] for k, (a, b, c) in enumerate(simhash.TRIPLES)])
    at = {int(f.astype("<i8")): i for i, f in enumerate(fps)}
    edges = simhash.forest_of(keys, np.tile(fps, 8), large)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3]
    assert brute.groups(len(fps), [(at[a], at[b]) for a, b in edges]) == brute.groups(len(fps), want)
    assert len(edges) < len(fps)


def test_every_pair_of_three_bits_meets_in_a_triple():
    from itertools import combinations

    for away in combinations(range(8), 3):
        assert any(not set(t) & set(away) for t in simhash.TRIPLES)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 80))).astype(np.uint8)
        b = bytes(t)
        sa = suffixes.suffix_array(t)
        assert list(sa) == sorted(range(len(b) + 1), key=lambda i: b[i:])
        shared = suffixes.common_prefixes(t, sa)
        for p, q in zip(sa, sa[1:]):
            k = 0
            while max(p, q) + k < len(b) and b[p + k] == b[q + k]:
                k += 1
            assert shared[q] == k


def test_suffix_array_sorts_reduced_strings_recursively():
    rng = np.random.default_rng(2)
    t = rng.integers(0, 256, 6000).astype(np.uint8)
    t = np.concatenate([t, t[500:4000], t[100:2000], t, t[:50]])  # long repeats: several levels, large alphabets
    b = bytes(t)
    assert list(suffixes.suffix_array(t)) == sorted(range(len(b) + 1), key=lambda i: b[i:])


def test_a_hot_minimizer_is_spread():
    """One minimizer in many contexts: no shard gets much of its text, and equal strings still meet."""
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 24).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 26), shared, rng.integers(97, 123, 26)]).astype(np.uint8) for _ in range(20_000)]
    texts[1] = texts[0]
    buf = np.concatenate(texts)
    starts = np.arange(len(texts)) * 76
    for twice in (False, True):
        run, a, z, mark = suffix_dedup.cut_further(buf, starts, starts + 27, np.full(len(texts), twice))
        assert np.bincount(run, z - a, minlength=len(texts)).tolist() == [27.0] * len(texts)  # each string in one cut
        assert ((a - starts[run]).tolist(), mark[run == 0].tolist()) == ((a - starts[run]).tolist(), mark[run == 1].tolist())
        amount = np.bincount((mark % np.uint64(256)).astype(np.int64), z - a + 49, minlength=256)
        assert amount.max() < 0.1 * amount.sum() and amount.sum() < 4 * len(buf)
        assert np.unique(mark[z - a > 0], return_counts=True)[1].max() < (0.08 if twice else 0.1) * len(mark)


def test_only_texts_that_share_a_minimizer_are_sorted(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b, c = ("".join(map(chr, rng.integers(97, 123, 70))) for _ in range(3))
    sorted_bytes = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda t, made=suffix_dedup.suffix_array: sorted_bytes.append(len(t)) or made(t))
    packet = lambda ids, texts, keys: {"text": "".join(texts).encode(), "lens": np.full(len(texts), 70, "<u4").tobytes(), "key": np.array(keys, "<u4").tobytes(), "n": np.ones(len(texts), "<u4").tobytes(), "doc": np.arange(len(texts)).astype("<u4").tobytes(), "pos": np.zeros(len(texts), "<u4").tobytes(), "id": np.array(ids, "<i8").tobytes()}
    marks = lambda rows: [np.frombuffer(m, "<u4").reshape(-1, 3).tolist() for m in suffix_dedup.judged(rows, 50)]
    # alone under its key: what it has first, all of it has
    assert marks([packet([5, 3], [a, b], [1, 2]), packet([4], [a], [1])]) == [[[0, 0, 70]], []]
    assert sorted_bytes == []
    # c ends as b begins: both are under one key, and a stays out
    assert marks([packet([5, 3, 9], [a, b, c[:10] + b[:60]], [1, 2, 2]), packet([4], [a], [1])]) == [[[0, 0, 70], [2, 10, 70]], []]
    assert sorted_bytes == [140]


def test_suffix_dedup(spark, docs, rows, no_docs):
    got = Counter(tuple(r) for r in suffix_dedup.digests(docs).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, brute.without_repeats([(r[0], r[1]) for r in rows])))
    assert suffix_dedup.digests(no_docs).collect() == []
    clash = docs.withColumn("frame", F.lit(1)).withColumn("marks", F.lit("m")).withColumn("keys", F.lit(None).cast("double"))
    kept = suffix_dedup.without_repeats(clash)
    assert kept.columns == clash.columns
    texts = {(r["doc_id"], r["text"], r["marks"]) for r in kept.collect()}
    assert (20, next(t for i, t, *_ in rows if i == 20), "m") in texts and not any(i in (21, 22, 23) for i, *_ in texts) and (50, None, "m") in texts


def test_small_lengths_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 30)), "".join(rng.choice(list("abé"), rng.integers(0, 400)))) for _ in range(60)]
    rows += [(i, "ab" * 200) for i in (1, 7, 7, 40)] + [(i, "a" * 300) for i in (2, 5)]
    got = Counter(tuple(r) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, brute.without_repeats(rows)))


def test_hot_runs_are_cut_in_the_query(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 64)  # nearly every repeated minimizer counts as hot
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    core, passage = prose(30), prose(90)
    rows = [(i, prose(40) + core + prose(40) + (passage if i % 4 == 0 else "")) for i in range(80)] + [(5, passage), (90, ""), (91, None)]
    got = Counter(tuple(r) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect())
    assert got == Counter((r[0], *w) for r, w in zip(rows, brute.without_repeats(rows)))


def test_quality_posteriors_against_plain_moments(spark, duck):
    from strataline.llm.queries import ORACLE_SQL, QUERIES
    from tests.compare import SF, same

    same(QUERIES["quality_posteriors"](spark, SF), duck, ORACLE_SQL["quality_posteriors"])
    rng = np.random.default_rng(8)
    rows = [(f"h{h}" if h else None, f"p{p}", float(np.clip(0.5 + 0.2 * np.sin(h) + 0.1 * np.cos(h + p) + rng.normal(0, 0.35), 0, 1))) for h in range(12) for p in range(3) for _ in range(int(rng.integers(1, 40)))]
    found, mean = quality.posteriors(spark.createDataFrame(rows, "site string, part string, e double"), ["site"], ["part"], "e")
    e = np.array([r[2] for r in rows])
    assert abs(mean - e.mean()) < 1e-12
    hosts, paths = ({k: np.array([x[2] for x in rows if key(x) == k]) for k in {key(x) for x in rows}} for key in (lambda x: x[0], lambda x: x[:2]))
    n, within = len(e), lambda g: sum(((v - v.mean()) ** 2).sum() for v in g.values()) / (len(e) - len(g))
    between_h = (sum(len(v) * (v.mean() - e.mean()) ** 2 for v in hosts.values()) - (len(hosts) - 1) * within(hosts)) / (n - sum(len(v) ** 2 for v in hosts.values()) / n)
    k = within(hosts) / between_h
    assert 1 < k < quality.STRONGEST
    host = {h: (v.sum() + k * e.mean()) / (len(v) + k) for h, v in hosts.items()}
    between_p = (sum(len(v) * (v.mean() - hosts[h].mean()) ** 2 for (h, _), v in paths.items()) - (len(paths) - len(hosts)) * within(paths)) / (n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items()))
    k = min(quality.STRONGEST, max(1.0, within(paths) / between_p)) if between_p > 0 else quality.STRONGEST
    assert found.count() == len(paths)
    for r in found.toDF("h", "p", "n", "host", "path").collect():
        v = paths[r["h"], r["p"]]
        assert r["n"] == len(v) and abs(r["host"] - host[r["h"]]) < 1e-9 and abs(r["path"] - (v.sum() + k * host[r["h"]]) / (len(v) + k)) < 1e-9


def test_quality(spark):
    from tests.compare import SF

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    made = quality.judge(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").select((F.col("verdict.keep") == (F.col("quality") == 1)).alias("right")).collect()
    assert sum(r["right"] for r in made) / len(made) > 0.95  # held out


def test_quality_edges(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")
    clash = docs.withColumn("evidence", F.lit(1)).withColumn("verdict", F.lit("x")).withColumn("h0", F.lit(2)).withColumn("site", F.lit(3))
    name = quality.verdict_column(clash)
    made = quality.judge(clash, labels)
    assert made.columns == [*clash.columns, name] and made.count() == len(rows)
    assert made.where(f"(text is null or trim(text, ' \\n\\t') = '') and {name}.keep").count() == 0
    assert quality.judge(no_docs, labels).collect() == []
    none = quality.judge(docs, labels.limit(0))
    assert none.where("verdict.keep").count() == sum(bool((r[1] or "").split()) for r in rows)


def test_sparse_sites_are_shrunk(spark):
    good, bad = "Plain words of a calm text.", "BUY!! NOW!! $$$ ||| ###"
    rows = [(i, good if i % 10 else bad, "l", "big") for i in range(200)] + [(200 + i, bad, "l", "poor") for i in range(100)] + [(400, good, "l", "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("text") == good).cast("int").alias("quality"))
    host = {r["source"]: r["h"] for r in quality.judge(docs, labels).select("source", "verdict.host").distinct().withColumnRenamed("host", "h").collect()}
    total = 181 / 301
    assert host["poor"] < 0.1 and host["big"] > 0.8 and total < host["lone"] < 0.95
