"""What the trees learn from covers all labelled URLs, whatever the sample of the fit."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler

from strataline.llm import urls

RULES = (("net/de/", "allow"), ("net/de/8", "block"))


def judged(spark, monkeypatch, rows, most):
    """Verdicts, and the features (suffix_rate, suffix_seen, weight) of what was fitted and scored, by URL."""
    frames = []
    plain = VectorAssembler.transform
    monkeypatch.setattr(VectorAssembler, "transform", lambda self, df, *a: frames.append(df) or plain(self, df, *a))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge(df, RULES, most=most, trees=2).collect()}
    return verdicts, frames


def test_suffix_statistics_are_of_all_rows(spark, monkeypatch):
    """300 suffixes with 3 labelled URLs each, and 40 URLs in the fit: none is unseen."""
    hosts = [f"a.s{k}.net" for k in range(300)]
    rows = [f"http://{h}/de/{'8' if k % 2 else '7'}{i}" for k, h in enumerate(hosts) for i in range(3)]
    rows += [f"http://{h}/other" for h in hosts]
    frames = []
    plain = VectorAssembler.transform
    monkeypatch.setattr(VectorAssembler, "transform", lambda self, df, *a: frames.append(df) or plain(self, df, *a))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string")
    urls.judge(df, RULES, most=40, trees=2)
    scored = frames[-1].select("host", "x_suffix_rate", "x_suffix_seen").collect()
    assert len(scored) == 300
    for r in scored:
        k = int(r["host"].split(".")[1][1:])
        assert abs(r["x_suffix_seen"] - 1.3862943611) < 1e-6  # log(1 + 3)
        assert abs(r["x_suffix_rate"] - ((3 if k % 2 else 0) + 4 * 0.5) / 7) < 1e-9


def test_one_url_cannot_fill_the_sample(spark, monkeypatch):
    """For any order of hashes: a URL with more copies than the sample is one of its entries, and both classes are seen."""
    for hot, other in (("7hot", "8"), ("8hot", "7")):
        rows = [f"http://x.net/de/{hot}"] * 60 + [f"http://x.net/de/{other}{i}" for i in range(10)] + ["http://y.net/z"]
        verdicts, frames = judged(spark, monkeypatch, rows, 20)
        fitted = frames[0].select("url", "weight", "label").collect()
        assert {r["url"]: r["weight"] for r in fitted}[f"http://x.net/de/{hot}"] == 60
        assert len(fitted) == 11 and {r["label"] for r in fitted} == {0.0, 1.0}
        assert len(verdicts) == len(rows)
        monkeypatch.undo()
