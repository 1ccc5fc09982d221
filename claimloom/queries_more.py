"""Queries of clusters, maps, searches, panels and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import decisions as D
from .operators import evaluate as E
from .operators import explain as X
from .operators import features as T
from .operators import ontology as O
from .operators import ranking as R
from .plans.claims import claims, concepts
from .queries_graph import CUTOFF, _B, _scored, _END, _FIRST, _cand, _paths, _top
from .queries_text import _LIFT, _W, _Z, _lifted, _norm, _sig_rows
from .session import table


def _override(spark, d, kind):
    m = table(spark, d, "manual_overrides").where(F.col("override_kind") == kind)
    return m.select(F.col("left_normalized_label").alias("u"), F.col("right_normalized_label").alias("v"), F.col("left_normalized_label").alias("label"))


def constrained_clusters(spark, d):
    t = table(spark, d, "tail_to_head_candidates").where("startswith(decision_status, 'accepted')").select(F.col("normalized_label").alias("u"), F.col("candidate_concept_id").alias("v"))
    iso = table(spark, d, "manual_overrides").where("override_kind = 'isolate_label'").select(F.coalesce("label", "left_normalized_label").alias("label"))
    return D.constrained_clusters(t, _override(spark, d, "block_pair"), iso, _override(spark, d, "merge_pair"))


def label_map_chain(spark, d):
    heads = table(spark, d, "head_concepts")
    hard = table(spark, d, "instance_mappings_hard").where("normalized_label is not null")
    labels = hard.select("normalized_label").distinct()
    exact = heads.select(F.col("preferred_label").alias("normalized_label"), "concept_id")
    unique = O.unique_signature_map(labels.withColumn("preferred_label", F.col("normalized_label")), heads)
    tail = table(spark, d, "tail_to_head_candidates").where("startswith(decision_status, 'accepted')").select("normalized_label", F.col("candidate_concept_id").alias("concept_id"))
    return D.label_map(labels, [("exact", exact), ("signature", unique), ("mapped", hard.select("normalized_label", "concept_id")), ("accepted", tail)])


TRIALS = [(1, 0.5, 0.2, 0.3, 0.2), (2, 0.8, 0.0, 0.2, 0.0), (3, 0.2, 0.2, 0.6, 0.3), (4, 0.0, 0.0, 1.0, 0.0)]


def _features(spark, d):
    return _scored(spark, d, 1996)


def weight_search(spark, d):
    pos = E.future_links(E.first_appearance(claims(spark, d)), [1997], [3])
    f = _features(spark, d).select("u", "v", *[F.round(c, 6).alias(c) for c in ("path_support_norm", "gap_bonus", "motif_bonus_norm", "hub_penalty")])
    return D.weight_search(f, pos, TRIALS, 1000).select("trial", "hits", "precision")


def _paths_top(spark, d, k, cutoff=1996):
    return R.top_ranked(T.path_features(claims(spark, d), cutoff, 2, 120), k, "path_support_raw")


def locked_predictions(spark, d):
    return D.locked_predictions(_paths_top(spark, d, 200), 1996, 3).withColumn("rank", F.col("rank").cast("int"))


def attention_panel(spark, d):
    pos = E.future_links(E.first_appearance(claims(spark, d)), [1997], [3])
    return D.attention_panel(_paths_top(spark, d, 2000), pos, 1_000_000, [100, 500, 2000])


def direct_to_path(spark, d):
    return D.direct_to_path(claims(spark, d), 1997, 3)


def review_queues(spark, d, cutoff=CUTOFF):
    c = claims(spark, d)
    p = T.path_features(c, cutoff, 2, 120).select("u", "v", F.round("path_support_raw", 6).alias("score"))
    m = T.motif_features(c, cutoff, 120).select("u", "v", F.round("motif_bonus_raw", 6).alias("score"))
    return D.review_queue([("paths", p), ("motifs", m)], 200)


def idea_briefs(spark, d, cutoff=CUTOFF):
    c = claims(spark, d)
    return X.briefs(_paths_top(spark, d, 20, cutoff).select("u", "v"), T.ranked_paths(c, cutoff, 120, 3), concepts(spark, d))


def node_strings(spark, d):
    return D.node_strings(table(spark, d, "nodes"))


def distinct_partners(spark, d):
    return D.distinct_partners(_lifted(spark, d))


def context_fingerprints(spark, d):
    return D.context_fingerprints(table(spark, d, "nodes"))


def oriented_pairs(spark, d):
    return D.oriented_pairs(_lifted(spark, d))


def topic_texts(spark, d):
    return D.topic_texts(table(spark, d, "works_topics"))


def weighted_centrality(spark, d):
    w = O.concept_weights(_lifted(spark, d))
    return w.select(F.explode(F.array("src", "dst")).alias("concept_id"), "weight").groupBy("concept_id").agg(F.round(F.sum("weight"), 4).alias("strength"))


QUERIES = {f.__name__: f for f in (constrained_clusters, label_map_chain, weight_search, locked_predictions, attention_panel, direct_to_path, review_queues, idea_briefs, node_strings, distinct_partners, context_fingerprints, oriented_pairs, topic_texts, weighted_centrality)}

_LABELED = "lab AS (SELECT substr(p_type, 1, 1) || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, p_name || ' ' || p_type || ' (' || p_brand || ')' AS label FROM part),\n"

ORACLES = {
    "constrained_clusters": """WITH RECURSIVE l AS (SELECT DISTINCT least(normalized_label, candidate_concept_id) AS u, greatest(normalized_label, candidate_concept_id) AS v FROM tail_to_head_candidates WHERE starts_with(decision_status, 'accepted') AND normalized_label <> candidate_concept_id),
iso AS (SELECT coalesce(label, left_normalized_label) AS label FROM manual_overrides WHERE override_kind = 'isolate_label'),
blk AS (SELECT least(left_normalized_label, right_normalized_label) AS u, greatest(left_normalized_label, right_normalized_label) AS v FROM manual_overrides WHERE override_kind = 'block_pair'),
k AS (SELECT u, v FROM l ANTI JOIN blk USING (u, v) WHERE u NOT IN (SELECT label FROM iso WHERE label IS NOT NULL) AND v NOT IN (SELECT label FROM iso WHERE label IS NOT NULL)
  UNION SELECT left_normalized_label, right_normalized_label FROM manual_overrides WHERE override_kind = 'merge_pair' AND left_normalized_label <> right_normalized_label),
sym AS (SELECT u AS a, v AS b FROM k UNION SELECT v, u FROM k),
reach AS (SELECT a AS node, a AS r FROM sym UNION SELECT s.b, reach.r FROM reach JOIN sym s ON s.a = reach.node WHERE reach.r < s.b)
SELECT node, min(r) AS component FROM reach GROUP BY 1""",
    "label_map_chain": _W + "hs AS (SELECT kind, signature, min(concept_id) AS concept_id FROM (" + _sig_rows("concept_id", "head_concepts") + ") WHERE signature <> '' GROUP BY 1, 2 HAVING count(DISTINCT concept_id) = 1),\nl AS (SELECT DISTINCT normalized_label, normalized_label AS preferred_label FROM instance_mappings_hard WHERE normalized_label IS NOT NULL),\nls AS (" + _sig_rows("normalized_label", "l") + """ WHERE signature <> ''),
s AS (SELECT normalized_label, min(concept_id) AS c FROM ls JOIN hs USING (kind, signature) GROUP BY 1 HAVING count(DISTINCT concept_id) = 1),
a AS (SELECT preferred_label AS normalized_label, min(concept_id) AS c FROM head_concepts WHERE concept_id <> '' GROUP BY 1),
b AS (SELECT normalized_label, min(concept_id) AS c FROM instance_mappings_hard WHERE concept_id <> '' AND normalized_label IS NOT NULL GROUP BY 1),
t AS (SELECT normalized_label, min(candidate_concept_id) AS c FROM tail_to_head_candidates WHERE starts_with(decision_status, 'accepted') AND candidate_concept_id <> '' GROUP BY 1)
SELECT normalized_label, coalesce(a.c, s.c, b.c, t.c) AS concept_id, CASE WHEN a.c IS NOT NULL THEN 'exact' WHEN s.c IS NOT NULL THEN 'signature' WHEN b.c IS NOT NULL THEN 'mapped' WHEN t.c IS NOT NULL THEN 'accepted' ELSE 'pending' END AS origin
FROM l LEFT JOIN a USING (normalized_label) LEFT JOIN s USING (normalized_label) LEFT JOIN b USING (normalized_label) LEFT JOIN t USING (normalized_label)""",
    "weight_search": _B + _cand(1996) + _FIRST + f"grid AS (SELECT * FROM (VALUES {', '.join(map(str, TRIALS))}) g(trial, a, b, c, d)),\nsc AS (SELECT trial, u, v, row_number() OVER (PARTITION BY trial ORDER BY round(a * round(path_support_norm, 6) + b * round(gap_bonus, 6) + c * round(motif_bonus_norm, 6) - d * round(hub_penalty, 6), 6) DESC, u, v) AS r FROM cand, grid QUALIFY r <= 1000),\n" + _END + "SELECT CAST(trial AS INT) AS trial, count(f.u) AS hits, round(count(f.u) / 1000, 6) AS precision FROM sc LEFT JOIN firsts f ON f.u = sc.u AND f.v = sc.v AND first_year BETWEEN 1997 AND 2000 GROUP BY 1",
    "locked_predictions": _B + _paths(1996) + _top(200, 1996) + _END + "SELECT 'MC-1996-H03-R' || lpad(CAST(rank AS VARCHAR), 4, '0') AS prediction_id, u, v, CAST(rank AS INT) AS rank, sha256('MC-1996-H03-R' || lpad(CAST(rank AS VARCHAR), 4, '0') || '|' || u || '|' || v) AS digest FROM top",
    "attention_panel": _B + _paths(1996) + _top(2000, 1996) + _FIRST + "h AS (SELECT t.*, f.u IS NOT NULL AS hit FROM top t LEFT JOIN firsts f ON f.u = t.u AND f.v = t.v AND first_year BETWEEN 1997 AND 2000),\nnp AS (SELECT count(*) AS np FROM firsts WHERE first_year BETWEEN 1997 AND 2000),\n" + _END + "SELECT CAST(k AS INT) AS k, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / k, 6) AS precision, round(max(np) / 1000000, 6) AS random_precision, round((count(*) FILTER (hit) / k) / (max(np) / 1000000), 6) AS lift, count(DISTINCT substr(u, 1, 1)) AS fields, round(avg(CAST(substr(u, 1, 1) <> substr(v, 1, 1) AS DOUBLE)), 6) AS cross_share FROM h, np, (SELECT unnest([100, 500, 2000]) AS k) WHERE rank <= k GROUP BY k",
    "direct_to_path": _B + _FIRST + "op AS (SELECT a.u, b.v, min(greatest(a.first_year, b.first_year)) AS opened FROM firsts a JOIN firsts b ON a.v = b.u GROUP BY 1, 2),\n" + _END + "SELECT f.u, f.v, CASE WHEN opened <= 2000 THEN opened END AS first_path_year FROM firsts f LEFT JOIN op o ON o.u = f.u AND o.v = f.v WHERE first_year <= 1997 AND (opened IS NULL OR opened > 1997)",
    "review_queues": _B + _cand(CUTOFF) + "qa AS (SELECT u, v, round(path_support_raw, 6) AS score FROM paths ORDER BY 3 DESC, u, v LIMIT 200),\nqb AS (SELECT u, v, round(motif_bonus_raw, 6) AS score FROM motifs ORDER BY 3 DESC, u, v LIMIT 200),\n" + _END + "SELECT u, v, 'paths' AS queue, score FROM qa UNION ALL SELECT u, v, 'motifs', score FROM qb ANTI JOIN qa USING (u, v)",
    "idea_briefs": _B + _paths(CUTOFF) + _top(20, CUTOFF) + _LABELED + "med AS (SELECT p.u, p.v, string_agg(label, '; ' ORDER BY r) AS via FROM (SELECT u, v, w, row_number() OVER (PARTITION BY u, v ORDER BY round(support, 6) DESC, w) AS r FROM paths2 QUALIFY r <= 3) p JOIN lab ON code = w GROUP BY 1, 2),\n" + _END + "SELECT t.u, t.v, a.label || ' -> ' || b.label || ' via ' || coalesce(via, 'no mediator') AS brief FROM top t JOIN lab a ON a.code = t.u JOIN lab b ON b.code = t.v LEFT JOIN med m ON m.u = t.u AND m.v = t.v",
    "node_strings": f"SELECT {_norm('label')} AS normalized_label, count(DISTINCT (custom_id, node_id)) AS instances, count(DISTINCT custom_id) AS papers, count(DISTINCT label) AS wordings, min(custom_id) AS first_paper FROM nodes WHERE label IS NOT NULL AND {_norm('label')} <> '' GROUP BY 1",
    "distinct_partners": _W + _LIFT + _Z + "SELECT concept_id, count(DISTINCT partner) AS partners, count(DISTINCT custom_id) AS papers FROM (SELECT custom_id, src AS concept_id, dst AS partner FROM lifted UNION ALL SELECT custom_id, dst, src FROM lifted) GROUP BY 1",
    "context_fingerprints": "SELECT sha1(coalesce(countries_json, '') || '|' || coalesce(end_year_json, '') || '|' || coalesce(start_year_json, '') || '|' || coalesce(unit_of_analysis_json, '') || '|' || coalesce(context_note, '')) AS fingerprint, count(DISTINCT (custom_id, node_id)) AS instances FROM nodes WHERE label IS NOT NULL GROUP BY 1",
    "oriented_pairs": _W + _LIFT + "g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) FILTER (src < dst) AS ab, count(*) FILTER (src > dst) AS ba FROM lifted GROUP BY 1, 2),\n" + _Z + "SELECT CASE WHEN ba > ab THEN b ELSE a END AS source, CASE WHEN ba > ab THEN a ELSE b END AS target, greatest(ab, ba) AS forward, least(ab, ba) AS reverse, CASE WHEN least(ab, ba) = 0 THEN 'one_way' WHEN least(ab, ba) * 2 >= greatest(ab, ba) THEN 'two_way' ELSE 'mostly_one_way' END AS arrow FROM g",
    "topic_texts": "SELECT work_id, string_agg(name, '|||' ORDER BY topic_seq) AS topics FROM (SELECT work_id, topic_seq, min(display_name) AS name FROM works_topics WHERE display_name IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY topic_seq) <= 5) GROUP BY 1",
    "weighted_centrality": _W + _LIFT + _Z + "SELECT concept_id, round(sum(weight), 4) AS strength FROM (SELECT src AS concept_id, weight FROM cw UNION ALL SELECT dst, weight FROM cw) GROUP BY 1",
}
