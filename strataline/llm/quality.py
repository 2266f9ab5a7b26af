"""Quality of documents by hierarchical empirical Bayes.

A document classifier (logistic regression on lexical shares, fitted on a bounded sample of labelled rows) gives each text
a probability. Means over hosts and over paths within hosts are shrunk: a host's towards the global mean, a path's
towards its host's. Each level has a variance within its sites and, beyond what that explains, one between them (moments of a
one-way analysis of variance); a site counts as if their quotient of documents had been added at the mean above, so a sparse
site says little and a large one much. The document's log odds are moved by those of its path relative to the global mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.llm.common import saved

#: Classes of bytes; their shares are the features.
CLASSES = ("upper", "lower", "digit", "space", "line", "stop", "shout", "bar", "symbol", "other")


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t"), ("line", b"\r\n"), ("stop", b".,;:'\"()-?"), ("shout", b"!"), ("bar", b"|"), ("symbol", b"#$%&*+/<=>@[\\]^_`{}~")):
        t[list(members)] = CLASSES.index(name)
    return t


TABLE = _class_table()
STRONGEST = 1e6  # documents added at the mean above, where sites don't differ beyond what chance explains


def features(texts: list[str | None]) -> np.ndarray:
    """One row a text: shares of byte classes, logs of length, word length and repetition; zeros if there is no text."""
    out = np.zeros((len(texts), len(CLASSES) + 4))
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        if not words:
            continue
        out[i, : len(CLASSES)] = np.bincount(TABLE[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES)) / len(raw)
        lines = raw.split(b"\n")
        out[i, len(CLASSES) :] = np.log1p(len(words)) / 10, np.log(len(raw) / len(words)), len(set(words)) / len(words), len(set(lines)) / len(lines)
    return out


class Logistic:
    """Standardised features, their roots and squares; ridge-penalised Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.spread = np.zeros(1), np.ones(1)
        z = self._expand(x)
        self.mean, self.spread = z.mean(0), z.std(0) + 1e-9
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (p - y) + ridge * self.w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(z.shape[1]), grad)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def _expand(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.abs(x)), x * x])

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((self._expand(x) - self.mean) / self.spread, -8, 8), np.ones((len(x), 1))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.w, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Logistic | None:
    """The classifier from at most `most` labelled documents (those whose ids have the least hashes); None without both classes.

    A document labelled more than once counts with the mean of its labels; null labels and ids are left out. Of texts under one
    id the one with the least hash is taken.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = saved(chosen, "labels")

    def work(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(features(b.column(2).to_pylist()).tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "h", "x"])

    # at most `most` pairs of numbers are broadcast, whatever the input
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", F.xxhash64("text").alias("h"))
    rows = rows.mapInArrow(work, "doc_id long, y double, h long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").collect()
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return Logistic(np.array([r["x"] for r in rows]), y)


def _spare(columns: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _with_evidence(docs: DataFrame, model: Logistic | None, name: str) -> DataFrame:
    """docs and a column with the classifier's probability: 0 for texts without a word, 1 without a model."""
    k = docs.columns.index("text")

    def work(batches):
        for b in batches:
            x = features(b.column(k).to_pylist())
            p = np.where(x.any(1), model.probability(x) if model is not None and len(x) else np.ones(len(x)), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def _log_odds(c: Column) -> Column:
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), c))
    return F.log(c / (1 - c))


def posteriors(scored: DataFrame, host: list[str], path: list[str], evidence: str) -> tuple[DataFrame, float]:
    """(a row a path: the columns of host and path, n, host and path: posterior means; the global mean).

    Partial sums in each task, so hot sites cost nothing; sums for each host are of those. Two rows of moments come to the driver.
    """
    e = F.col(evidence)
    paths = saved(scored.groupBy(*host, *path).agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q")), "paths")
    hosts = paths.groupBy(*host).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    hosts = saved(hosts, "hosts")
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = min(1 - 1e-6, max(1e-6, (total[1] or 0.0) / total[0])) if total[0] else 0.5

    def strength(groups: DataFrame, above: Column, above_n: Column, n_above: int) -> float:
        """Within variance by between variance of sites about the means of the level above (n_above of them, above_n rows each)."""
        m = F.col("s") / F.col("n")
        r = groups.agg(F.count("*"), F.sum("n"), F.sum(F.col("q") - F.col("n") * m * m), F.sum(F.col("n") * (m - above) ** 2), F.sum(F.col("n") - F.col("n") * F.col("n") / above_n)).first()
        sites, n, inside, apart, room = r
        if not n or sites <= n_above or not room:
            return STRONGEST
        within = max(0.0, inside) / (n - sites) if n > sites else mean * (1 - mean)
        between = (apart - (sites - n_above) * within) / room
        return min(STRONGEST, max(1.0, within / between)) if between > 0 else STRONGEST

    k_host = strength(hosts, F.lit(mean), F.lit(total[0] or 1), 1)
    means = hosts.select(*[F.col(c).alias(f"h_{c}") for c in host], F.col("n").alias("host_n"), (F.col("s") / F.col("n")).alias("host_mean"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host"))
    both = paths.join(means, [paths[c].eqNullSafe(means[f"h_{c}"]) for c in host]).select(*host, *path, "n", "s", "q", "host_n", "host_mean", "host")
    k_path = strength(both, F.col("host_mean"), F.col("host_n"), hosts.count())
    return both.select(*host, *path, "n", "host", ((F.col("s") + k_path * F.col("host")) / (F.col("n") + k_path)).alias("path")), mean


def judge(docs: DataFrame, labels: DataFrame, host: list[Column] | None = None, path: list[Column] | None = None, threshold: float = 0.5, most: int = 20_000) -> DataFrame:
    """docs with struct column `verdict` (evidence, host, path: posterior means, score, keep); no row is dropped.

    host: columns that name a site, path: columns that name a part of it; nulls are values of their own. A text without a
    word (null, empty, blank) has evidence 0 and is not kept. Without labels of both classes every other document is kept.
    Texts are read whole, however long. Repeated rows count and are judged each, so ties need no order. A table without rows
    gives none. Columns of docs may have any names; `verdict` gets a trailing _ if it is taken.
    """
    host = host or [F.col("source")]
    path = path or [F.col("lang")]
    model = train(docs, labels, most)
    p, verdict = _spare(docs.columns, "evidence"), _spare(docs.columns, "verdict")
    names = [f"h{i}" for i in range(len(host))], [f"p{i}" for i in range(len(path))]
    keys = [c.cast("string").alias(n) for c, n in zip([*host, *path], [*names[0], *names[1]])]
    found, mean = posteriors(_with_evidence(docs.select("text", *keys), model, "evidence"), *names, "evidence")
    sites = saved(found, "sites")
    taken = [*docs.columns, p]
    site = _spare(taken, "site")
    sites = sites.select(*[F.col(n).alias(_spare(taken, f"site_{n}")) for n in [*names[0], *names[1]]], F.struct(F.col("host"), F.col("path")).alias(site))

    scored = _with_evidence(docs, model, p)
    at = [c.cast("string").eqNullSafe(sites[_spare(taken, f"site_{n}")]) for c, n in zip([*host, *path], [*names[0], *names[1]])]
    score = 1 / (1 + F.exp(-(_log_odds(F.col(p)) + _log_odds(F.col(f"{site}.path")) - _log_odds(F.lit(mean)))))
    score = F.when(F.col(p) == 0, F.lit(0.0)).otherwise(score)
    full = F.struct(F.col(p).alias("evidence"), F.col(f"{site}.host").alias("host"), F.col(f"{site}.path").alias("path"), score.alias("score"), (score >= threshold).alias("keep"))
    return scored.join(sites, at).select(*[scored[c] for c in docs.columns], full.alias(verdict))


def verdict_column(docs: DataFrame) -> str:
    """The name that judge gives its column."""
    return _spare(docs.columns, "verdict")


def quality_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior means of hosts and paths given evidence that is a plain function of the length of a document."""
    from strataline.llm.common import table

    docs = table(spark, sf_dir, "documents").withColumn("evidence", F.least(F.lit(1.0), F.coalesce("n_chars", F.lit(0)) / 5000.0))
    found, _ = posteriors(docs, ["source"], ["lang"], "evidence")
    return found.select("source", "lang", "n", F.round("host", 6).alias("host"), F.round("path", 6).alias("path"))


#: The same by SQL.
POSTERIORS_SQL = """WITH d AS (SELECT source, lang, least(1.0::DOUBLE, coalesce(n_chars, 0) / 5000.0::DOUBLE) AS e FROM documents),
p AS (SELECT source, lang, CAST(count(*) AS DOUBLE) AS n, sum(e) AS s, sum(e * e) AS q FROM d GROUP BY source, lang),
h AS (SELECT source, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM p GROUP BY source),
t AS (SELECT count(*) AS n_hosts, sum(n) AS n, greatest(1e-6, least(1 - 1e-6, sum(s) / sum(n))) AS m FROM h),
vh AS (SELECT sum(q - s * s / h.n) / nullif(max(t.n) - count(*), 0) AS w, sum(h.n * power(s / h.n - t.m, 2)) AS a, count(*) - 1 AS df, sum(h.n - h.n * h.n / t.n) AS room FROM h, t),
kh AS (SELECT CASE WHEN df > 0 AND room > 0 AND a - df * w > 0 THEN least(1e6, greatest(1, w / ((a - df * w) / room))) ELSE 1e6 END AS k FROM vh),
hp AS (SELECT h.source, h.n, h.s / h.n AS mean, (h.s + kh.k * t.m) / (h.n + kh.k) AS post FROM h, kh, t),
vp AS (SELECT sum(p.q - p.s * p.s / p.n) / nullif(max(t.n) - count(*), 0) AS w, sum(p.n * power(p.s / p.n - hp.mean, 2)) AS a, count(*) - max(t.n_hosts) AS df, sum(p.n - p.n * p.n / hp.n) AS room FROM p JOIN hp ON p.source IS NOT DISTINCT FROM hp.source, t),
kp AS (SELECT CASE WHEN df > 0 AND room > 0 AND a - df * w > 0 THEN least(1e6, greatest(1, w / ((a - df * w) / room))) ELSE 1e6 END AS k FROM vp)
SELECT p.source, p.lang, CAST(p.n AS BIGINT) AS n, round(hp.post, 6) AS host, round((p.s + kp.k * hp.post) / (p.n + kp.k), 6) AS path FROM p JOIN hp ON p.source IS NOT DISTINCT FROM hp.source, kp"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataline.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "verdict.evidence", "verdict.host", "verdict.path", "verdict.score", "verdict.keep")
