"""Queries of the general data operators (problems 1 and 4) and their SQL."""

from __future__ import annotations

from .operators.orphans import track_claims
from .operators.shred import node_tables, shred
from .session import table


def _tracker(spark, d):
    return track_claims(spark, *(table(spark, d, t) for t in ("edges", "instance_mappings_soft", "nodes", "head_concepts")))


def p1_found(spark, d):
    return _tracker(spark, d).orphans().select("ref_table", "ref_field", "custom_id", "item_id", "reason")


def p1_snapshot(spark, d):
    from pyspark.sql import functions as F

    return _tracker(spark, d).snapshot().select("ref_table", "ref_field", F.date_format("period", "yyyy-MM").alias("period"), "reason", "orphans")


def _nested(spark, d):
    return (table(spark, d, t) for t in ("works_base", "works_topics", "works_abstracts", "works_raw"))


def p4_found(spark, d):
    return shred(*_nested(spark, d))


def p4_node_counts(spark, d):
    from pyspark.sql import functions as F

    n = node_tables(*_nested(spark, d))
    return n.groupBy("source", "node_type").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"), F.sum(F.col("post") - F.col("pre")).alias("span"))


_ORPHANS = """
WITH refs AS (
  SELECT 'edges' AS ref_table, 'source_node_id' AS ref_field, custom_id, edge_id AS item_id, 'n'||custom_id||chr(1)||source_node_id AS k, ingested_at AS t FROM edges
  UNION ALL SELECT 'edges', 'target_node_id', custom_id, edge_id, 'n'||custom_id||chr(1)||target_node_id, ingested_at FROM edges
  UNION ALL SELECT 'instance_mappings_soft', 'concept_id', custom_id, node_id, 'c'||concept_id, ingested_at FROM instance_mappings_soft),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_table, ref_field, custom_id, item_id ORDER BY t, k NULLS FIRST) AS rn FROM refs) WHERE rn = 1 AND k IS NOT NULL),
events AS (SELECT 'n'||custom_id||chr(1)||node_id AS k, ingested_at AS t, coalesce(is_deleted, false) AS gone FROM nodes
  UNION ALL SELECT 'c'||concept_id, ingested_at, head_status = 'retired' FROM head_concepts),
parents AS (SELECT k, min(t) AS first_at, (max({'t': t, 'g': gone})).g AS gone FROM events GROUP BY k),
found AS (SELECT f.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.first_at > f.t THEN 'late' END AS reason FROM firsts f LEFT JOIN parents p USING (k))
"""

QUERIES = {"p1_found": p1_found, "p1_snapshot": p1_snapshot, "p4_found": p4_found, "p4_node_counts": p4_node_counts}
ORACLES = {
    "p1_found": _ORPHANS + "SELECT ref_table, ref_field, custom_id, item_id, reason FROM found WHERE reason IS NOT NULL",
    "p1_snapshot": _ORPHANS + "SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS period, reason, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
