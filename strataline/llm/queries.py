"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from strataline.llm.ann import op4_nearest
from strataline.llm.bpe import op8_byte_bpe
from strataline.llm.clustering import lloyd_sql, op13_centroids
from strataline.llm.embedding_dedup import op10_embedding_dedup
from strataline.llm.packing import op7_packing
from strataline.llm.periodic import PERIODIC_SQL, op11_periodic_runs
from strataline.llm.pii import op12_pii
from strataline.llm.quality import POSTERIORS_SQL, op6_quality, quality_posteriors
from strataline.llm.simhash import COMPONENTS_SQL, fingerprint_components, op5_simhash
from strataline.llm.suffix_dedup import op3_suffix_dedup
from strataline.llm.token_counts import op9_token_counts
from strataline.llm.token_files import op2_token_files
from strataline.llm.urls import RULES_SQL, op1_url_filter, url_rules

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_token_files": op2_token_files,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_nearest": op4_nearest,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pii": op12_pii,
    "op13_centroids": op13_centroids,
    # parts of operators that SQL can express too
    "url_rules": url_rules,
    "fingerprint_components": fingerprint_components,
    "quality_posteriors": quality_posteriors,
}
#: The other operators are learned, hash or encode, which SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "url_rules": RULES_SQL,
    "fingerprint_components": COMPONENTS_SQL,
    "quality_posteriors": POSTERIORS_SQL,
    "op11_periodic_runs": PERIODIC_SQL,
    "op13_centroids": lloyd_sql(),
    "op10_embedding_dedup": """WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(i, j) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i), n AS (SELECT i, count(*) AS n_links FROM l GROUP BY i)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.i = e.vec_id LEFT JOIN n ON n.i = e.vec_id""",
}
