"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from strataline.plans import chart_queries, cohort_queries, image_queries, layout_queries, naming_queries, plane_queries, profile_queries, sheet_queries, skeleton_queries, stats_queries

FLAGSHIP = "cohort_ladder"
_MODULES = [cohort_queries, stats_queries, profile_queries, chart_queries, naming_queries, image_queries, sheet_queries, plane_queries, layout_queries, skeleton_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
