"""Queries of concept frames, labels, roll-ups and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import decisions as D
from .operators import features as T
from .operators import ontology as O
from .operators import panels as P
from .operators import ranking as R
from .plans.claims import claims
from .queries_graph import _B, _END, _cand, _edges, _pairs, _scored, CUTOFF
from .queries_more import ORACLES as _MORE, constrained_clusters
from .queries_text import _EVIDENCE, _LIFT, _W, _Z, _lifted, _norm
from .session import table


def concept_paper_edges(spark, d):
    return P.concept_paper_edges(_lifted(spark, d))


def concept_edge_stats(spark, d):
    return P.concept_edge_stats(P.concept_paper_edges(_lifted(spark, d)))


def concept_node_frames(spark, d):
    return P.concept_nodes(table(spark, d, "instance_mappings_soft"))


def cluster_support(spark, d):
    m = table(spark, d, "head_selection_metrics").where("normalized_label is not null").groupBy(F.col("normalized_label").alias("node")).agg(F.sum("instance_count").alias("support"), F.round(F.max("head_rank_score"), 6).alias("score"))
    return P.cluster_summary(constrained_clusters(spark, d), m)


def decision_labels(spark, d):
    rows = P.decision_labels(R.novelty(_scored(spark, d).withColumn("path_support_norm", F.round("path_support_norm", 6))))
    return rows.groupBy("slice_label", "direct_status", "play").agg(F.count(F.lit(1)).alias("n"))


def corridor_summary(spark, d):
    return P.corridors(R.novelty(_scored(spark, d).withColumn("score", F.round("score", 6))))


def label_concept_support(spark, d):
    return P.label_concept_support(table(spark, d, "instance_mappings_hard"), table(spark, d, "instance_mappings_soft"))


def family_rollup(spark, d):
    return P.family_rollup(table(spark, d, "works_base"))


def head_pool_capped(spark, d):
    return P.head_pool_capped(D.node_strings(table(spark, d, "nodes")), 5, 0.9, 400)


def document_sizes(spark, d):
    return P.document_sizes(table(spark, d, "documents"))


def enriched_papers(spark, d):
    one = lambda df: df.groupBy("work_id").agg(F.min("display_name").alias("title"), F.min("publication_year").alias("year")).select(F.col("work_id").alias("id"), "title", "year")
    w = table(spark, d, "works_base")
    return P.enriched_papers(one(w), one(w.where("corpus_bucket = 'core'")))


def boundary_links(spark, d):
    c = claims(spark, d)
    later = c.where(F.col("year") > CUTOFF).select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    return P.boundary_set(later, T.underexplored_pairs(c, 2, CUTOFF))


def ring_layout(spark, d):
    w = O.concept_weights(_lifted(spark, d))
    s = w.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.round(F.sum("weight"), 4).alias("strength"))
    return P.ring_layout(s.orderBy(F.desc("strength"), "node").limit(200))


def paper_labels(spark, d):
    return P.paper_labels(table(spark, d, "works_base").select("work_id", "publication_year", "display_name").distinct())


def profile_similarity(spark, d):
    e = _lifted(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), "relationship_type", "sign")
    prof = P.value_profiles(ends, "id", "relationship_type", "relations").join(P.value_profiles(ends, "id", "sign", "signs"), "id", "full")
    return P.profile_similarity(e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), prof, ["relations", "signs"])


def question_window(spark, d):
    """Front window of the best candidates with caps per pair of fields and per concept."""
    top = R.top_ranked(_scored(spark, d), 2000)
    family = F.concat(F.substring("u", 1, 1), F.lit(">"), F.substring("v", 1, 1))
    return P.capped_selection(top.select("u", "v", "rank", family.alias("family")), 60, 3, 2)


def best_pairs_in_order(spark, d):
    top = R.top_ranked(_scored(spark, d), 500)
    wanted = top.groupBy(F.concat_ws("__", F.least("u", "v"), F.greatest("u", "v")).alias("pair_key")).agg(F.min("rank").cast("long").alias("place"))
    return P.best_per_pair(top, wanted)


def batch_validation(spark, d):
    return P.validate_batch(table(spark, d, "edges"), ["custom_id", "edge_id", "source_node_id", "target_node_id", "sign"], "edge_id")


def display_order(spark, d):
    top = R.top_ranked(_scored(spark, d), 1000).select("u", "v", "score", F.round("gap_bonus", 6).alias("specificity"), F.col("mediator_count").alias("paths"))
    return P.display_priority(top).select("u", "v", "display_priority", "place")


def top_means(spark, d):
    return P.top_means(R.top_ranked(_scored(spark, d), 100).withColumn("gap", F.round("gap_bonus", 6)), 40, ["score", "gap", "mediator_count"])


QUERIES = {f.__name__: f for f in (concept_paper_edges, concept_edge_stats, concept_node_frames, cluster_support, decision_labels, corridor_summary, label_concept_support, family_rollup, head_pool_capped, document_sizes, enriched_papers, boundary_links, ring_layout, paper_labels, profile_similarity, question_window, best_pairs_in_order, batch_validation, display_order, top_means)}

# ---------------------------------------------------------------- SQL


def _case(c, table_, other):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {other} END"


_STABILITY = "greatest(0.0, least(1.0, round(" + " + ".join([_case("claim_status", P.CLAIM_POINTS, 0.40), _case("explicitness", P.EXPLICITNESS_POINTS, 0.0), _case("tentativeness", P.TENTATIVENESS_POINTS, 0.0), _case("causal_presentation", P.CAUSAL_POINTS, 0.0)]) + ", 9)))::DOUBLE"
_PE = _W + _LIFT + f"pe AS (SELECT custom_id, src, dst, bool_or(coalesce(causal_presentation IN ('explicit_causal', 'implicit_causal'), false)) AS is_causal, {_EVIDENCE} AS weight, round(avg({_STABILITY}), 6) AS stability FROM lifted GROUP BY 1, 2, 3),\n"
_VALUES = "rk AS (SELECT custom_id, src, dst, {c}, row_number() OVER (PARTITION BY custom_id, src, dst ORDER BY n DESC, {c}) AS r FROM (SELECT custom_id, src, dst, {c}, count(*) AS n FROM lifted WHERE {c} NOT IN ('', 'NA') GROUP BY 1, 2, 3, 4)),\n"
_TOP = "tops AS (SELECT u, v, round(score, 6) AS score, gap_bonus, mediator_count, row_number() OVER (ORDER BY round(score, 6) DESC, u, v) AS rank FROM cand QUALIFY rank <= {k}),\n"
_CROSS = "substr(u, 1, 1) <> substr(v, 1, 1)"


def _cosine(a, b):
    dot = f"list_sum(list_transform(map_keys({a}), lambda k: {a}[k] * coalesce({b}[k], 0)))"
    norm = lambda m: f"sqrt(list_sum(list_transform(map_values({m}), lambda x: x * x)))"
    return f"round(coalesce({dot} / nullif({norm(a)} * {norm(b)}, 0), 0)::DOUBLE, 6)"


ORACLES = {
    "concept_paper_edges": _PE + _VALUES.replace("rk AS", "ra AS").format(c="relationship_type") + _VALUES.replace("rk AS", "rb AS").format(c="evidence_method") + _Z + "SELECT pe.*, coalesce(ra.relationship_type, 'other') AS relationship_type, coalesce(rb.evidence_method, 'do_not_know') AS evidence_method FROM pe LEFT JOIN ra ON ra.custom_id = pe.custom_id AND ra.src = pe.src AND ra.dst = pe.dst AND ra.r = 1 LEFT JOIN rb ON rb.custom_id = pe.custom_id AND rb.src = pe.src AND rb.dst = pe.dst AND rb.r = 1",
    "concept_edge_stats": _PE + _Z + "SELECT src, dst, count(*) AS papers, round(sum(weight), 6) AS weight, round(avg(stability), 6) AS mean_stability FROM pe GROUP BY 1, 2",
    "concept_node_frames": "WITH f AS (SELECT custom_id, (min({'t': ingested_at, 'c': concept_id, 'l': normalized_label, 'x': confidence})) AS f FROM instance_mappings_soft GROUP BY custom_id, node_id) SELECT f.c AS concept_id, count(*) AS instances, count(DISTINCT custom_id) AS papers, round(avg(f.x), 6) AS mean_confidence, round(avg(CAST(coalesce(f.x, 0) < 0.8 AS DOUBLE)), 6) AS low_confidence_share, count(DISTINCT f.l) AS wordings FROM f WHERE f.c <> '' GROUP BY 1",
    "cluster_support": "WITH c AS (" + _MORE["constrained_clusters"] + "), m AS (SELECT normalized_label AS node, sum(instance_count) AS s, round(max(head_rank_score), 6) AS b FROM head_selection_metrics WHERE normalized_label IS NOT NULL GROUP BY 1) SELECT component, count(*) AS size, CAST(coalesce(sum(s), 0) AS BIGINT) AS support, max(b) AS best_score FROM c LEFT JOIN m USING (node) GROUP BY 1",
    "decision_labels": _B + _cand(CUTOFF) + _END + f"""SELECT CASE WHEN cooc_count <= 0 THEN 'Missing direct link' WHEN p >= 0.95 THEN 'Ready to follow through' WHEN gap_bonus >= 0.85 AND cooc_count <= 2 THEN 'Early but promising' WHEN {_CROSS} THEN 'Connect separate literatures' ELSE 'Support from nearby literature' END AS slice_label,
  CASE WHEN cooc_count <= 0 THEN 'No direct papers yet' WHEN cooc_count = 1 THEN 'One direct paper so far' WHEN cooc_count <= 5 THEN 'A few direct papers already exist' ELSE 'Direct work already exists' END AS direct_status,
  CASE WHEN {_CROSS} AND cooc_count <= 0 AND p >= 0.7 THEN 'Bridge paper across literatures' WHEN {_CROSS} AND cooc_count <= 0 THEN 'Scoping review before a bridge paper' WHEN gap_bonus >= 0.4 AND mediator_count >= 25 THEN 'Direct empirical test' WHEN gap_bonus >= 0.4 THEN 'Synthesis plus pilot design'
    WHEN p >= 0.8 AND motif_count >= 100 THEN 'Flagship empirical paper' WHEN p >= 0.7 THEN 'Focused empirical test' ELSE 'Seminar seed or targeted replication map' END AS play, count(*) AS n FROM (SELECT *, round(path_support_norm, 6) AS p FROM cand) GROUP BY 1, 2, 3""",
    "corridor_summary": _B + _cand(CUTOFF) + _END + f"SELECT substr(u, 1, 1) AS source_field, substr(v, 1, 1) AS target_field, count(*) AS ideas, round(avg(round(score, 6)), 6) AS mean_score, round(avg(CAST({_CROSS} AND cooc_count <= 0 AS DOUBLE)), 6) AS boundary_share, round(median(round(score, 6)), 6) AS median_score FROM cand GROUP BY 1, 2",
    "label_concept_support": "SELECT normalized_label, concept_id, count(*) AS support FROM (SELECT normalized_label, concept_id FROM instance_mappings_hard UNION ALL SELECT normalized_label, concept_id FROM instance_mappings_soft) WHERE normalized_label IS NOT NULL AND concept_id <> '' GROUP BY 1, 2 HAVING count(*) >= 3",
    "family_rollup": "WITH f AS (SELECT list_sort(list({'o': source_host_organization, 's': source_display_name, 'c': cited_by_count}), 'ASC', 'NULLS FIRST')[1] AS f FROM works_base GROUP BY work_id), w AS (SELECT f.o AS o, f.s AS s, f.c AS c FROM f WHERE f.o IS NOT NULL) SELECT o AS source_host_organization, count(*) AS works, CAST(coalesce(sum(c), 0) AS BIGINT) AS citations, min(s) AS first_source, (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT x.s FROM w x WHERE x.o = w.o AND x.s IS NOT NULL ORDER BY 1 LIMIT 10)) AS sources FROM w GROUP BY o",
    "head_pool_capped": f"WITH s AS (SELECT {_norm('label')} AS normalized_label, count(DISTINCT (custom_id, node_id)) AS instances, count(DISTINCT custom_id) AS papers FROM nodes WHERE label IS NOT NULL AND {_norm('label')} <> '' GROUP BY 1), t AS (SELECT count(*) FILTER (papers >= 5) AS n, coalesce(sum(instances) FILTER (papers >= 5), 0) / sum(instances) AS share FROM s), r AS (SELECT *, row_number() OVER (ORDER BY instances DESC, normalized_label) AS k FROM s WHERE papers < 5) SELECT normalized_label, 'distinct_papers_threshold' AS reason FROM s WHERE papers >= 5 UNION ALL SELECT normalized_label, 'coverage_mass_capped' FROM r, t WHERE share < 0.9 AND k <= 400 - n",
    "document_sizes": r"SELECT doc_kind, count(*) AS docs, CAST(sum(ceil(length(trim(coalesce(text, ''), ' ')) / 4)) AS BIGINT) AS tokens, CAST(max(ceil(length(trim(coalesce(text, ''), ' ')) / 4)) AS BIGINT) AS longest FROM documents GROUP BY 1",
    "enriched_papers": f"WITH w AS (SELECT work_id AS id, min(display_name) AS title, min(publication_year) AS year FROM works_base GROUP BY 1), k AS (SELECT work_id AS id, min(display_name) AS title, min(publication_year) AS year FROM works_base WHERE corpus_bucket = 'core' GROUP BY 1), a AS (SELECT id, {_norm('title')} AS t, year FROM w), b AS (SELECT id, {_norm('title')} AS t, year FROM k), x AS (SELECT t, year, min(id) AS m FROM b WHERE t <> '' AND year IS NOT NULL GROUP BY 1, 2), y AS (SELECT t, min(id) AS m FROM b WHERE t <> '' GROUP BY 1) SELECT a.id, coalesce(x.m, y.m) AS match, CASE WHEN x.m IS NOT NULL THEN 'title_year' WHEN y.m IS NOT NULL THEN 'title' ELSE 'none' END AS kind FROM a LEFT JOIN x ON x.t = a.t AND x.year = a.year LEFT JOIN y ON y.t = a.t",
    "boundary_links": _B + _pairs(CUTOFF) + _END + f"SELECT DISTINCT src AS u, dst AS v FROM claims c WHERE year > {CUTOFF} AND substr(src, 1, 1) <> substr(dst, 1, 1) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.u = least(src, dst) AND p.v = greatest(src, dst))",
    "ring_layout": _W + _LIFT + "s AS (SELECT node, round(sum(weight), 4) AS strength FROM (SELECT src AS node, weight FROM cw UNION ALL SELECT dst, weight FROM cw) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200),\n" + _Z + "SELECT node, round(cos(2 * pi() * (row_number() OVER (ORDER BY strength DESC, node) - 1) / (SELECT count(*) FROM s)), 6) AS x, round(sin(2 * pi() * (row_number() OVER (ORDER BY strength DESC, node) - 1) / (SELECT count(*) FROM s)), 6) AS y FROM s",
    "paper_labels": r"SELECT DISTINCT work_id, coalesce(regexp_extract(work_id, '(W\d+)', 1), '') AS short_id, CASE WHEN coalesce(regexp_extract(work_id, '(W\d+)', 1), '') <> '' THEN 'https://openalex.org/' || regexp_extract(work_id, '(W\d+)', 1) ELSE '' END AS url, coalesce(trim(display_name), '') || CASE WHEN publication_year > 0 THEN ' (' || publication_year || ')' ELSE '' END AS label FROM (SELECT DISTINCT work_id, publication_year, display_name FROM works_base)",
    "profile_similarity": _W + _LIFT + "en AS (SELECT src AS id, relationship_type AS r, sign AS s FROM lifted UNION ALL SELECT dst, relationship_type, sign FROM lifted),\npr AS (SELECT id, map(list(r), list(n)) AS m FROM (SELECT id, r, CAST(count(*) AS DOUBLE) AS n FROM en WHERE r <> '' GROUP BY 1, 2) GROUP BY 1),\nps AS (SELECT id, map(list(s), list(n)) AS m FROM (SELECT id, s, CAST(count(*) AS DOUBLE) AS n FROM en WHERE s <> '' GROUP BY 1, 2) GROUP BY 1),\nprs AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM lifted),\n" + _Z + f"SELECT u, v, {_cosine('a.m', 'b.m')} AS relations, {_cosine('c.m', 'e.m')} AS signs FROM prs LEFT JOIN pr a ON a.id = u LEFT JOIN pr b ON b.id = v LEFT JOIN ps c ON c.id = u LEFT JOIN ps e ON e.id = v",
    "best_pairs_in_order": _B + _cand(CUTOFF) + _TOP.format(k=500) + _END + "SELECT least(u, v) || '__' || greatest(u, v) AS pair_key, min(rank) AS place, (min({'a': -score, 'u': u, 'v': v})).u AS u, (min({'a': -score, 'u': u, 'v': v})).v AS v, max(score) AS score FROM tops GROUP BY 1",
    "batch_validation": "SELECT error, count(*) AS rows FROM (SELECT unnest(['custom_id', 'edge_id', 'source_node_id', 'target_node_id', 'sign']) AS c, unnest([custom_id, edge_id, source_node_id, target_node_id, sign]) AS x FROM edges), (SELECT 1), LATERAL (SELECT 'missing ' || c AS error) WHERE x IS NULL OR trim(x) = '' GROUP BY 1 UNION ALL SELECT * FROM (SELECT 'repeated edge_id', CAST(sum(n) AS BIGINT) AS s FROM (SELECT count(*) AS n FROM edges WHERE edge_id IS NOT NULL GROUP BY edge_id HAVING count(*) > 1)) WHERE s > 0",
    "display_order": _B + _cand(CUTOFF) + _TOP.format(k=1000) + "p AS (SELECT u, v, score, round(score + 0.05 * round(gap_bonus, 6) + 0.01 * mediator_count, 6) AS display_priority FROM tops),\n" + _END + "SELECT u, v, display_priority, row_number() OVER (ORDER BY display_priority DESC, score DESC, u, v) AS place FROM p",
    "top_means": _B + _cand(CUTOFF) + _TOP.format(k=40) + _END + "SELECT count(*) AS rows, round(avg(score), 6) AS mean_score, round(avg(round(gap_bonus, 6)), 6) AS mean_gap, round(avg(mediator_count), 6) AS mean_mediator_count FROM tops",
}
