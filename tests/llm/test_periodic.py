"""Periodic runs against a plain scan of every period, and against SQL."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from strataline.llm import periodic, queries
from tests.compare import SF, same


def runs(w, fold=4, least=6):
    found = {}
    for p in range(1, len(w) // fold + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, fold * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def kept(w, found):
    gone = {i for a, n, p in found for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_sequences(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(rng.randint(1, 30)):
        n, k = rng.choice([0, 1, 3, 5, 6, 7, 20, 60, 200]), rng.choice([1, 2, 3, 10])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:
            a, p = rng.randrange(n // 2), rng.randint(1, n // 5)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        docs.append(w)
    fold, least = rng.choice([(4, 6), (3, 3), (5, 12)])
    got = periodic.runs_in(np.array([x for w in docs for x in w], np.int64), np.array([*map(len, docs)]), fold, least)
    assert got == [runs(w, fold, least) for w in docs]


def test_prefixes_of_long_repeats():
    s = np.tile(np.arange(1, 8), 3000).astype(np.int32)
    sa = periodic.word_suffix_array(s)
    assert sa[1:].tolist() == sorted(range(len(s)), key=lambda i: (s[i], -i))
    shared = periodic.word_prefixes(np.append(s, 0), sa)
    assert all(shared[i] == (len(s) - max(sa[i], sa[i - 1]) if s[sa[i] % 7] == s[sa[i - 1] % 7] and sa[i - 1] < len(s) else 0) for i in range(1, len(s)))


def test_operator_on_edge_documents(spark, docs, rows):
    more = [(900, "a b " * 5000, "en", "s", 1), (901, "x\x0by\x0cx y\tx y\nx y", "en", "s", 1), (902, "é é é é é é é é é é é é", "en", "s", 1), (903, "q " * 7 + "r " * 6, "en", "s", 1)]
    df = docs.union(spark.createDataFrame(more, docs.schema)).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(df).collect()), key=repr)
    want = sorted(((r[0], len(w := words(r[1])), runs(w), kept(w, runs(w))) for r in [*rows, *more]), key=repr)
    assert got == want


def test_no_rows(no_docs):
    assert periodic.digests(periodic.periodic_runs(periodic.with_planted(no_docs))).collect() == []


def test_digests(docs, rows):
    def one(doc_id, text):
        w = words(text)
        if doc_id is not None and w and (h := crc32(str(doc_id).encode())) % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs(w)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
        return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha256(lines.encode()).hexdigest(), sha256(kept(w, found).encode()).hexdigest())

    got = [tuple(r) for r in periodic.digests(periodic.periodic_runs(periodic.with_planted(docs))).collect()]
    assert sorted(got, key=repr) == sorted((one(r[0], r[1]) for r in rows), key=repr)


def test_query_and_sql(spark, duck):
    same(queries.QUERIES["op11_periodic_runs"](spark, SF), duck, queries.ORACLE_SQL["op11_periodic_runs"])
