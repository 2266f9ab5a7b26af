"""The pipeline's near-duplicate stage on planted copies, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strataline.llm import jaccard
from tests.compare import SF
from tests.llm import brute


def runs(text, shingle=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted():
    """200 texts, and of each a copy with words at the end exchanged, so that the similarity is about 0.72 to 0.95."""
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    common = prose(30)
    rows, likeness = [], []
    for i in range(200):
        base = prose(120) + common * (i % 3 == 0)
        copy = list(base)
        cut = rng.randrange(3, 22)
        copy[:cut] = prose(cut)
        rows += [(i, " ".join(base)), (1000 + i, " ".join(copy))]
        likeness.append(similarity(runs(rows[-2][1]), runs(rows[-1][1])))
    hot = prose(100)
    rows += [(3000 + i, " ".join(hot[:i] + prose(1) + hot[i + 1 :])) for i in range(60)]  # a chain through many lists
    rows += [(4000, " ".join(hot[:5])), (4001, "two words"), (4002, "Two  WORDS"), (4003, None), (4004, " "), (4005, " ".join(common))]
    # exactly 0.8: 8 runs of 10
    rows += [(5000, " ".join(f"e{i}" for i in range(13))), (5001, " ".join(f"e{i}" for i in range(12))), (5002, " ".join(f"f{i}" for i in range(12))), (5003, " ".join(f"f{i}" for i in range(14)))]
    return rows, likeness


def components(rows, least=0.8):
    sets = [runs(t) for _, t in rows]
    root = brute.groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similarity(sets[i], sets[j]) >= least])
    lowest = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return {i: lowest[r] for (i, _), r in zip(rows, root)}


def test_planted_copies_are_all_found(spark):
    import corpus_pipeline

    rows, likeness = planted()
    assert min(likeness) < 0.75 and max(likeness) > 0.94
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    want = components(rows)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()} == want
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, SF).collect()}
    assert kept == {i for i, c in want.items() if i == c}
    assert {1000 + i for i, s in enumerate(likeness) if s >= 0.8}.isdisjoint(kept)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.95])
def test_other_similarities(spark, least):
    rows = planted()[0][:120]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df, least=least).collect()} == components(rows, least)


def test_long_documents_that_share_a_third(spark):
    """Each pair shares many members of long prefixes, none is near; and one of a million words stands beside them."""
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = prose(13_333)
    rows = [(i, " ".join(common + prose(26_667))) for i in range(4)] + [(10, " ".join(prose(1_000_000)))]
    near = " ".join(rows[0][1].split()[:39_000])
    df = spark.createDataFrame([*rows, (20, near)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 10: 10, 20: 0}


def test_parities_differ_in_at_most_as_many_bits_as_the_sets_in_members():
    rng = np.random.default_rng(4)
    pool = rng.integers(-(2**63), 2**63 - 1, 3000)
    sets = [np.unique(rng.choice(pool, k)) for k in (0, 1, 5, 40, 300, 2000, 3000)]
    sets += [np.setdiff1d(m, m[:k]) for m in sets for k in (1, 3)]
    bits = np.unpackbits(jaccard.parities(sets).view("u1"), axis=1)
    assert jaccard.parities([]).shape[0] == 0 and not jaccard.parities([sets[0]]).any()
    for a, x in zip(sets, bits):
        for b, y in zip(sets, bits):
            differ = len(np.setxor1d(a, b))
            assert (x != y).sum() <= differ and (x != y).sum() % 2 == differ % 2
