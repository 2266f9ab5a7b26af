"""Operators on URLs and vectors against brute force, and the pipeline's stages."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataline.llm import ann, embedding_dedup, simhash, urls
from strataline.llm.queries import ORACLE_SQL, QUERIES
from strataline.llm.vectors import sample_rows
from tests.compare import SF, same
from tests.llm import brute
from tests.llm.test_near_dedup import components

URLS = ["https://a.EXAMPLE.com/en/712?x=1", "http://example.com/en/8", "http://xexample.com/en/8", "http://example.net/de/8", "http://q.example.net/de/9#z", "net/de/8", None, "", "://", "http://", "http://Ä.Org/es/", "x://org/es/a://net/de/", "http://h?://net/de/", "http://a.b\nc.com/en/", "http://com/en/", "http://com/en", "http://é.net/de/8/../?a=b&c=d"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS * 3)], "page_id long, url string, host int")
    got = {(r["page_id"]): r for r in urls.judge(pages.select("page_id", "url", "host")).collect()}
    assert len(got) == 3 * len(URLS)
    for i, u in enumerate(URLS * 3):
        host, path = brute.url_parts(u)
        rule, verdict = brute.rule_of(host, path, urls.RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] in ("allow", "block") and verdict in (None, got[i]["verdict"])


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none).collect() == []
    one = spark.createDataFrame([(1, "http://com/en/1"), (2, "http://other.xyz/"), (None, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(one).collect()} == {"block"}  # a single class
    plain = spark.createDataFrame([(1, "http://other.xyz/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(plain).collect()] == ["allow"]  # no labels


def test_url_trees_learn(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"http://{'a' * int(rng.integers(3, 6))}.example.net/de/{'7' if k else '8'}{'x' * (3 if k else 40)}{rng.integers(1e6)}") for i, k in enumerate(rng.integers(0, 2, 400))]
    rows += [(1000 + i, f"http://other.net/{'y' * (4 if i % 2 else 41)}") for i in range(40)]
    rules = (("net/de/", "allow"), ("example.net/de/8", "block"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    right = sum((got[1000 + i] == "allow") == bool(i % 2) for i in range(40))
    assert right >= 36  # held out: long ones are blocked


def vectors():
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    base = [np.array(v) for _, v in rows[:20]]
    rows += [(500 + i, (b + 0.15 * rng.standard_normal(16)).tolist()) for i, b in enumerate(base * 3)]
    rows += [(600 + i, (b * 3).tolist()) for i, b in enumerate(base[:4])] + [(700, rows[0][1]), (701, rows[0][1]), (3, rows[3][1]), (None, rows[5][1])]
    rows += [(800, None), (801, [0.0] * 16), (802, [float("nan")] + [1.0] * 15), (803, [float("inf")] * 16), (804, [None] + [1.0] * 15), (805, [])]
    # two from different clusters linked through a third
    a, b = base[7] / np.linalg.norm(base[7]), rng.standard_normal(16)
    b = b - (b @ a) * a
    b /= np.linalg.norm(b)
    rows += [(900 + k, (np.cos(t) * a + np.sin(t) * b).tolist()) for k, t in enumerate((0.4, 0.8, 1.2, 1.6))]
    return rows


@pytest.mark.parametrize("chunk, pivots, width", [(4096, 16, 8), (16, 5, 4)])
def test_embedding_dedup(spark, chunk, pivots, width):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, entry int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, chunk=chunk, pivots=pivots, width=width).collect()), key=repr)
    want = sorted(((i, n, c, i is not None and i == c) for (i, _), (n, c) in zip(rows, brute.cosine_links(rows))), key=repr)
    assert got == want


def test_embedding_pairs_copy_no_vectors(spark, monkeypatch):
    """However many chunks meet, a vector is written once to one chunk; pairs of chunks pass no shuffle. Pairs lie across many planes."""
    given, made = {}, {}
    monkeypatch.setattr(embedding_dedup, "saved", lambda df, name, real=embedding_dedup.saved: given.update({name: df}) or made.setdefault(name, real(df, name)))
    x = np.random.default_rng(4).standard_normal((600, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, cosine=0.99, chunk=16, pivots=40).collect()}
    want = (x @ x.T >= 0.99).sum(1) - 1
    assert got == dict(enumerate(want.tolist())) and max(got.values()) > 2
    assert made["chunks"].count() > 40 and made["chunks"].selectExpr("sum(length(ids)) / 8", "max(length(ids)) / 8 < 48").first()[:] == (600, True)
    plan = given["links"]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_embedding_dedup_like_its_sql(spark, duck):
    same(QUERIES["op10_embedding_dedup"](spark, SF), duck, ORACLE_SQL["op10_embedding_dedup"])


def test_embedding_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).collect() == []
    assert ann.search(none, none).collect() == []
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(zero).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert ann.search(zero, zero).collect() == []


def exact_neighbours(rows, ids, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and brute.usable(v)]
    at = dict(ok)
    out = {}
    for q in ids:
        if q in at:
            found = sorted(((float((at[q] * v).sum()), i) for i, v in ok if i != q), key=lambda x: (-x[0], x[1]))[:k]
            out[q] = found
    return out


def test_ann_small_is_exact_with_ties(spark):
    rows = vectors()[:10] + vectors()[460:490]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, part int")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), chunk=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact_neighbours(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [(r, i) for r, i, _ in got[q]] == [(k, i) for k, (_, i) in enumerate(found, 1)]
        assert np.allclose([s for *_, s in got[q]], [s for s, _ in found], rtol=0, atol=1e-12)


def test_ann_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), chunk=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact_neighbours(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert np.mean([len(got[q] & {i for _, i in f}) / len(f) for q, f in want.items()]) >= 0.9


def test_balanced_parts():
    x = np.random.default_rng(0).standard_normal((320, 8))
    sizes = np.bincount(ann.balanced_parts(x, 16, 10, 1))
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1


def test_every_operator_is_registered():
    numbered = [k for k in QUERIES if re.match(r"op\d+_", k)]
    assert sorted(int(k[2:].split("_")[0]) for k in numbered) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["url_rules", "fingerprint_components", "quality_posteriors"])
def test_parts_like_their_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i + 1), 1.0, 0.5]) for i in range(8)] + [(20, [1.0, 2.0]), (21, [1.0, 2.0]), (22, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (20, 21, 22)) and got[7]["component_id"] < 7
    found = ann.search(df, df.where("vec_id % 20 = 0")).collect()
    assert {r["query_id"] for r in found} == {0} and {r["vec_id"] for r in found} == set(range(1, 8))


def test_two_vectors_under_one_query_id(spark):
    rows = [(i, [float(i % 3), 1.0 + i]) for i in range(12)]
    both = spark.createDataFrame([(0, [5.0, 1.0]), (0, [1.0, 5.0])] * 3, "vec_id long, embedding array<double>")
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    answers = {tuple((r["rank"], r["vec_id"]) for r in ann.search(base, both.repartition(n)).orderBy("rank").collect()) for n in (1, 3, 6)}
    assert len(answers) == 1


def test_parts_and_sample_grow_with_the_rows(spark):
    assert [ann.parts_of(n, 4096) for n in (0, 50_000, 600_000, 10_000_000, 10**11)] == [16, 16, 32, 128, 128]
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)] + [(i, [float(i), 3.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert len(sample_rows(many, "embedding", 25)) == 25 and len(sample_rows(many, "embedding", 99)) == 41  # copies count once


def test_crowded_postings_are_dealt_out(spark):
    rng = np.random.default_rng(0)
    fps = set()
    for b in rng.integers(0, 1 << 40, 12).tolist():
        for _ in range(60):
            x = b  # upper three bytes alike in all
            for bit in rng.integers(0, 40, rng.integers(0, 4)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    want = brute.groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    at = {f: i for i, f in enumerate(fps)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (5, 100, 10**6):
        links = [(at[r["u"]], at[r["v"]]) for r in simhash.near_links(df, hot=hot).collect()]
        assert brute.groups(len(fps), links) == want


def test_pipeline(spark):
    import corpus_pipeline as c
    from strataline.llm.common import saved, table

    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in c.STAGES:
        seen.append(saved(stage(spark, seen[-1], SF), "test"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    labels = table(spark, SF, "labels")
    assert seen[1].join(labels.where("quality = 0"), "doc_id").count() <= 1
    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    keep = sorted(i for i, comp in components(rows).items() if i == comp)
    assert sorted(r["doc_id"] for r in seen[2].collect()) == keep
    rows = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    want = {i: n - g for (i, _), (n, g, *_) in zip(rows, brute.without_repeats(rows))}
    got = {r["doc_id"]: len(r["text"].encode()) for r in seen[3].collect()}
    assert all(abs(got.get(i, 0) - n) <= 8 for i, n in want.items()) and set(want) - set(got) <= {i for i, n in want.items() if n <= 4}
    assert seen[4].agg({"length": "sum"}).first()[0] == seen[4].select("doc_id", "doc_tokens").distinct().agg({"doc_tokens": "sum"}).first()[0]


def test_pipeline_stages_on_edges(spark, docs, no_docs):
    import corpus_pipeline as c

    for name, stage in c.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
    kept = c.near_dedup_stage(spark, docs, SF)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 20 in ids and not {21, 22, 23} & set(ids)
    assert ids.count(None) == 1  # the other row without an id is a copy of document 20


def test_every_pipeline_stage_takes_edge_documents(spark, docs, rows):
    import corpus_pipeline as c

    given = docs.withColumn("verdict", F.lit(1)).withColumn("frame", F.lit("f")).withColumn("key", F.lit(2)).withColumn("part", F.lit(3))
    kept = c.quality_stage(spark, given, SF)
    assert kept.columns == given.columns
    texts = [r["text"] for r in kept.select("text").collect()]
    assert len(texts) <= len(rows) and all((t or "").split() for t in texts)  # nothing without a word
    shorter = c.suffix_stage(spark, given, SF)
    assert shorter.columns == given.columns
    lone = [(i, t) for i, t, *_ in rows if i is not None and t and len(t) < 50 and i not in (20,)]
    left = {(r["doc_id"], r["text"]) for r in shorter.select("doc_id", "text").collect()}
    assert set(lone) <= left and (50, None) in left and (51, "") in left
    packed = c.packing_stage(spark, given, SF)
    pieces = packed.collect()
    assert sum(p["length"] for p in pieces) == sum(len(i) + 1 for i in encoded([r[1] or "" for r in rows]))
    assert all(len(p["ids"]) == 4 * p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"] for p in pieces)


def encoded(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
