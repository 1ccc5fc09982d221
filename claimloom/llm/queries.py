"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .canonical import UNMATCHED, map_labels, unresolved_labels
from .grid_components import match_groups
from .leaks import leaks
from .packing import pack
from .refine import formatting_copies
from .residue import residue, residue_scores
from .sentences import sentence_units


def p2_found(spark, d):
    return match_groups(table(spark, d, "tail_to_head_candidates"), table(spark, d, "manual_overrides"))


def p2_group_sizes(spark, d):
    return p2_found(spark, d).groupBy("run_id", "group_id").agg(F.count(F.lit(1)).alias("members"))


def p3_found(spark, d):
    return residue(table(spark, d, "works_abstracts"), table(spark, d, "works_base"))


def p3_hosts(spark, d):
    """Texts and cases per host."""
    scored, _ = residue_scores(table(spark, d, "works_abstracts"), table(spark, d, "works_base"))
    return scored.groupBy("host").agg(F.count(F.lit(1)).alias("texts"), F.count_if("is_case").alias("cases"))


def p5_found(spark, d):
    labels = unresolved_labels(table(spark, d, "instance_mappings_hard"), table(spark, d, "nodes"))
    return map_labels(labels, table(spark, d, "head_concepts")).select("custom_id", "node_id", "concept_id")


def p5_misses(spark, d):
    """Labels that name no entry of the list, with the number of instances."""
    labels = unresolved_labels(table(spark, d, "instance_mappings_hard"), table(spark, d, "nodes"))
    misses = map_labels(labels, table(spark, d, "head_concepts")).where(F.col("concept_id") == UNMATCHED)
    return misses.groupBy("label").agg(F.count(F.lit(1)).alias("instances"))


def _copies(spark, d):
    heads = table(spark, d, "head_selection_metrics").select(F.lit("head_selection_metrics").alias("tbl"), F.lit("h").alias("scope"), F.lpad(F.col("row_id").cast("string"), 10, "0").alias("member_key"), F.col("normalized_label").alias("label"))
    nodes = table(spark, d, "nodes").select(F.lit("nodes").alias("tbl"), F.concat(F.lit("n"), "custom_id").alias("scope"), F.concat_ws("/", "custom_id", "node_id").alias("member_key"), "label")
    return formatting_copies(heads.unionByName(nodes))


def _table_of(c):
    return F.when(F.col(c) == "h", "head_selection_metrics").otherwise("nodes")


def p6_found(spark, d):
    return _copies(spark, d).select(_table_of("scope").alias("tbl"), "member_key", "group_key").distinct()


def p6_collapsed(spark, d):
    """One record per label with its number of copies (groups of two or more)."""
    return _copies(spark, d).select(_table_of("scope").alias("tbl"), "group_key", "copies").distinct()


def p7_packing(spark, d):
    return pack(table(spark, d, "documents"))[0]


def p7_certificate(spark, d):
    """Containers used, the lower bound that certifies them, and the share of room wasted."""
    _, r = pack(table(spark, d, "documents"))
    waste = 1 - r["tokens"] / max(1, r["containers"] * r["capacity"])
    return spark.createDataFrame([(r["containers"], r["bound"], r["tokens"], r["rounds"], waste)], "containers long, lower_bound long, tokens long, rounds int, waste double")


def p7_invariants(spark, d):
    """What any packing must keep: every document placed, nothing overfull, no piece twice, no short document split, no fewer containers than the bound."""
    packed, r = pack(table(spark, d, "documents"))
    load = packed.groupBy("container").agg(F.sum("tokens").alias("load")).agg(F.count_if(F.col("load") > r["capacity"]).alias("overfull"))
    twice = packed.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("tokens"), F.max("start_token").alias("last"))
    docs = per.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= r["capacity"])).alias("split_short"), F.count_if(F.col("last") != (F.col("parts") - 1) * r["capacity"]).alias("broken"))
    return docs.crossJoin(load).crossJoin(twice).select("*", F.lit(r["containers"] >= r["bound"]).alias("bound_holds"))


def p8_found(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark, d):
    """Leaked items and in how many documents each occurs."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_found(spark, d):
    return sentence_units(table(spark, d, "documents"))


def p9_counts(spark, d):
    """Sentences per document, and the longest of them."""
    return p9_found(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.max(F.col("end_char") - F.col("start_char")).alias("longest"))


_LINKS = """
WITH RECURSIVE links AS (
  SELECT run_id, normalized_label AS a, candidate_concept_id AS b FROM tail_to_head_candidates WHERE starts_with(decision_status, 'accepted')
  UNION SELECT run_id, left_normalized_label, right_normalized_label FROM manual_overrides WHERE override_kind = 'merge_pair'),
sym AS (SELECT run_id, a, b FROM links WHERE a <> b AND a <> '' AND b <> '' UNION SELECT run_id, b, a FROM links WHERE a <> b AND a <> '' AND b <> ''),
reach AS (SELECT run_id, a, a AS b FROM sym UNION SELECT r.run_id, r.a, s.b FROM reach r JOIN sym s ON s.run_id IS NOT DISTINCT FROM r.run_id AND s.a = r.b),
found AS (SELECT run_id, a AS member_key, min(b) AS group_id FROM reach GROUP BY ALL)
"""
_SAME = """
WITH rows_ AS (
  SELECT DISTINCT 'head_selection_metrics' AS tbl, '' AS scope, lpad(row_id::VARCHAR, 10, '0') AS member_key, normalized_label AS label FROM head_selection_metrics
  UNION SELECT 'nodes', custom_id, custom_id || '/' || node_id, label FROM nodes),
keyed AS (SELECT DISTINCT tbl, scope, member_key, array_to_string(list_sort(list_filter(regexp_split_to_array(translate(replace(lower(label), 'ß', 'ss'), 'ςſ', 'σs'), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: w <> '')), ' ') AS k FROM rows_ WHERE label IS NOT NULL),
groups AS (SELECT tbl, scope, k, min(member_key) AS group_key, count(DISTINCT member_key) AS copies FROM keyed WHERE k <> '' GROUP BY ALL HAVING copies > 1)
"""

_WINDOWS = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(regexp_replace(lower(nfc_normalize(text)), '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]', ' ', 'g'), '[\p{L}\p{N}]+') AS t, 10 AS n FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'd', doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]'), 20 FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\x{3400}-\x{9FFF}]')
  UNION ALL SELECT 'i', item_id, regexp_extract_all(regexp_replace(lower(nfc_normalize(passage)), '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]', ' ', 'g'), '[\p{L}\p{N}]+'), 10 FROM eval_items WHERE NOT starts_with(lower(coalesce(lang, '')), 'zh') AND passage IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(nfc_normalize(passage)), '[\p{L}\p{N}]'), 20 FROM eval_items WHERE starts_with(lower(lang), 'zh') AND passage IS NOT NULL),
grams AS (SELECT DISTINCT side, id, n, unnest(list_transform(generate_series(1, len(t) - n + 1), lambda i: array_to_string(list_slice(t, i, i + n - 1), ' '))) AS g FROM words WHERE len(t) >= n),
found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g AND d.n = i.n WHERE d.side = 'd' AND i.side = 'i')
"""

QUERIES = {"p2_found": p2_found, "p2_group_sizes": p2_group_sizes, "p3_found": p3_found, "p3_hosts": p3_hosts, "p5_found": p5_found, "p5_misses": p5_misses, "p6_found": p6_found, "p6_collapsed": p6_collapsed, "p7_packing": p7_packing, "p7_certificate": p7_certificate, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_counts": p9_counts}
ORACLES = {
    "p2_found": _LINKS + "SELECT run_id, member_key, group_id FROM found",
    "p2_group_sizes": _LINKS + "SELECT run_id, group_id, count(*) AS members FROM found GROUP BY ALL",
    "p6_found": _SAME + "SELECT DISTINCT tbl, member_key, group_key FROM keyed JOIN groups USING (tbl, scope, k)",
    "p7_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0 AS split_short, 0 AS broken, 0 AS overfull, 0 AS repeated, true AS bound_holds FROM documents",
    "p8_found": _WINDOWS + "SELECT doc_id, item_id FROM found",
    "p8_items": _WINDOWS + "SELECT item_id, count(*) AS documents FROM found GROUP BY 1",
    "p6_collapsed": _SAME + "SELECT tbl, group_key, copies FROM groups",
}
