"""Personal data: base patterns against plain regular expressions, planted contexts, edge rows."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import pytest

from strataline.llm import pii, queries
from tests.compare import SF

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(t):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(d[::-1]))
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and total % 10 == 0, 9 <= len(d) <= 15][k]:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@pytest.mark.parametrize("seed", range(20))
def test_base_spans_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(400):
        t = "".join(rng.choice(["@", ".", "a", "b-", "1", "4111111111111111", "255", "+1", " ", "-", "(", ")", "é", "\n", "79927398713", "@x.y"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "x" * 200_000, "x@" * 100_000, "1." * 100_000, "+1" * 100_000, "a at " * 50_000):
        pii.candidates(t, pii.base_spans(t))


def found(df):
    return {r["doc_id"]: {(s["start"], s["end"], pii.KINDS[s["kind"]]) for s in r["spans"]} for r in df.collect()}


def test_contexts_find_unseen_forms_and_leave_others(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "and", "of", "river", "stone", "was", "for", "number"]) for _ in range(n))
    rows, want = [], {}

    def add(i, text, own=(), kind=None):
        rows.append((i, text))
        want[i] = {(text.index(x), text.index(x) + len(x), kind) for x in own}

    for i in range(30):
        add(i, f"{prose(9)} call me at: +1 (555) {rng.randrange(100, 999)}-{i:04d} {prose(5)}", [], None)
        add(100 + i, f"{prose(9)} write to mailbox u{i}@mail.example.com {prose(5)}")
        add(200 + i, f"{prose(9)} order item {rng.randrange(10**9, 10**10)} {prose(5)} for {rng.randrange(10**8, 10**9)} {prose(3)}")
    for i in range(8):
        add(300 + i, f"{prose(3)} call me at 555-23{i}-4567, {prose(5)}", [f"555-23{i}-4567"], "phone")
        add(400 + i, f"{prose(3)} write to mailbox v{i} [at] host [dot] org {prose(5)}", [f"v{i} [at] host [dot] org"], "email")
    add(500, "known elsewhere u3 (at) mail.example.com here", ["u3 (at) mail.example.com"], "email")
    # a second round: this context has only values that the first one accepts
    for i in range(8):
        add(600 + i, f"ring our desk 555-23{i}-4567 {prose(4)}", [f"555-23{i}-4567"], "phone")
    got = found(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    for i, text in rows:
        assert got[i] == want[i] | {(s, e, pii.KINDS[k]) for s, e, k in pii.base_spans(text)}, (text, got[i])


def test_edge_rows(spark, docs, rows, no_docs):
    got = pii.personal_data(docs.withColumnRenamed("lang", "base").withColumnRenamed("source", "id")).collect()
    as_text = lambda spans: [(s["start"], s["end"], s["kind"]) for s in spans]
    assert sorted(((r["doc_id"], as_text(r["base"])) for r in got), key=repr) == sorted(((r[0], pii.base_spans(r[1] or "")) for r in rows), key=repr)
    assert pii.personal_data(no_docs).collect() == []


def test_query_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base]
        assert r["base_sha256"] == sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == pii.KINDS[x] for _, _, x in base) for k in pii.KINDS]
        assert r["n_added"] == 0 and (r["spans"] == ",".join(names))
