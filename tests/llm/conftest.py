import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage, base = prose(40), prose(120)
    rows = [(i, prose(rng.randint(5, 90)), "en", "src0" if i % 3 else f"src{i % 4}") for i in range(20)]
    rows += [(20 + i, base, "en", "src1") for i in range(4)]  # copies
    rows += [(30 + i, base.replace("a", "b", 1) + " " + prose(1), "fr", "src2") for i in range(3)]  # near copies
    rows += [(40 + i, prose(10) + "\n" + passage + " " + prose(8), "de", None) for i in range(5)]  # a shared passage
    rows += [(50, None, "en", "src0"), (51, "", None, "src0"), (52, " \n\t ", "en", "src0"), (53, "word", "en", "src9"), (54, "Two  words", "en", "src9")]
    rows += [(None, base, "en", "src1"), (None, prose(30), "en", "src1"), (3, rows[3][1], "en", "src0"), (4, rows[4][1] + " other", "en", "src0")]
    rows += [(60, "x" * 40_000, "en", "src0"), (61, "x" * 20_000 + " y", "en", "src0"), (62, prose(3000), "en", "src0"), (63, "naïve “quotes” 日本語 \u00a0 e\u0301 <|endoftext|> don't\r\n\r\nI'M 1234 \x00 z", "en", "src3")]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d in rows]


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "text")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
