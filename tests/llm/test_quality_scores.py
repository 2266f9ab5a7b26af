"""The registered quality query, all its columns, recomputed from the texts one by one."""

import math
from collections import Counter, defaultdict

import numpy as np

from strataline.llm import quality
from strataline.llm.queries import QUERIES
from tests.compare import SF


def measured(text):
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return None
    kinds = [lambda c: c.isupper(), lambda c: c.islower(), lambda c: c.isdigit(), lambda c: c in b" \t", lambda c: c in b"\r\n", lambda c: c in b".,;:'\"()-?", lambda c: c == b"!", lambda c: c == b"|", lambda c: c in b"#$%&*+/<=>@[\\]^_`{}~"]
    seen = Counter(next((k for k, of in enumerate(kinds) if of(bytes([c]))), 9) for c in raw)
    lines = raw.split(b"\n")
    x = [seen[k] / len(raw) for k in range(10)] + [math.log(1 + len(words)) / 10, math.log(len(raw) / len(words)), len({*words}) / len(words), len({*lines}) / len(lines)]
    return x + [math.sqrt(abs(v)) for v in x] + [v * v for v in x]


def fitted(x, y):
    """Weights of the ridge-penalised likelihood, by weighted least squares on working responses."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        eta = x @ w
        p = 1 / (1 + np.exp(-eta))
        weight = np.maximum(p * (1 - p), 1e-12)
        response = eta + (y - p) / weight
        w = np.linalg.solve(x.T @ (x * weight[:, None]) + np.eye(len(w)), x.T @ (weight * response))
    return w


def shrunk(values, above, prior):
    """Means of groups drawn to the mean above each: values by group, the group above each, the prior mean of that."""
    e = np.concatenate(list(values.values()))
    parents = defaultdict(list)
    for g, v in values.items():
        parents[above(g)].append(v)
    centre = {p: np.concatenate(vs).mean() for p, vs in parents.items()}
    size = {p: sum(map(len, vs)) for p, vs in parents.items()}
    within = sum(((v - v.mean()) ** 2).sum() for v in values.values()) / (len(e) - len(values))
    apart = sum(len(v) * (v.mean() - centre[above(g)]) ** 2 for g, v in values.items())
    room = sum(len(v) - len(v) ** 2 / size[above(g)] for g, v in values.items())
    between = (apart - (len(values) - len(parents)) * within) / room if room > 0 and len(values) > len(parents) else 0.0
    k = min(quality.STRONGEST, max(1.0, within / between)) if between > 0 else quality.STRONGEST
    return {g: (v.sum() + k * prior(g)) / (len(v) + k) for g, v in values.items()}


def test_every_score_of_the_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]
    label = defaultdict(list)
    for i, q in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect():
        if i is not None and q is not None:
            label[i].append(q)
    width = 3 * 14
    x = np.array([measured(t) or [0.0] * width for _, t, _, _ in docs])
    chosen = [k for k, d in enumerate(docs) if d[0] in label]
    assert len({d[0] for d in docs}) == len(docs) and 10 < len(chosen) <= 20_000
    y = np.array([np.mean(label[docs[k][0]]) for k in chosen])
    mean, spread = x[chosen].mean(0), x[chosen].std(0) + 1e-9
    z = np.hstack([np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(z @ fitted(z[chosen], y), -30, 30)))
    p = np.where([measured(t) is not None for _, t, _, _ in docs], p, 0.0)

    hosts, paths = defaultdict(list), defaultdict(list)
    for v, (_, _, source, lang) in zip(p, docs):
        hosts[source].append(v)
        paths[source, lang].append(v)
    hosts, paths = ({g: np.array(v) for g, v in m.items()} for m in (hosts, paths))
    overall = p.mean()
    host = shrunk(hosts, lambda g: None, lambda g: overall)
    path = shrunk(paths, lambda g: g[0], lambda g: host[g[0]])
    odds = lambda v: math.log(min(1 - 1e-6, max(1e-6, v)) / (1 - min(1 - 1e-6, max(1e-6, v))))

    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, SF).collect()}
    assert set(got) == {d[0] for d in docs}
    for v, (i, _, source, lang) in zip(p, docs):
        score = 1 / (1 + math.exp(-(odds(v) + odds(path[source, lang]) - odds(overall)))) if v else 0.0
        for name, want in (("evidence", v), ("host", host[source]), ("path", path[source, lang]), ("score", score)):
            assert abs(got[i][name] - want) < 1e-6, (i, name)
        assert got[i]["keep"] == (score >= 0.5) or abs(score - 0.5) < 1e-6
    assert 0 < sum(r["keep"] for r in got.values()) < len(got)
