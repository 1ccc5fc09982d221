"""Queries of the ontology, ELT, quality and search operators on the claim tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import labels as L
from .operators import elt as B
from .operators import ontology as O
from .operators import search as S
from .operators.shred import shred
from .session import table


def _counts(spark, d):
    return O.label_counts(table(spark, d, "nodes").select("label"))


def _preferred(spark, d):
    return O.preferred_labels(_counts(spark, d))


def label_signatures(spark, d):
    x = table(spark, d, "nodes").where("label is not null").select("label").distinct()
    return x.select("label", *[v.alias(k) for k, v in L.signatures(F.col("label")).items()])


#: Fixed cases of label normalisation beyond ASCII: raw label and its form.
LABEL_CASES = [("Ｇｒｏｗｔｈ　Ｒａｔｅ", "growth rate"), ("ﬁnancial ﬂows", "financial flows"), ("Straße", "strasse"), ("carbon—emissions", "carbon-emissions"), ("R＆D / Ｉｎｎｏｖａｔｉｏｎ", "r and d innovation"), ("CO₂ tax", "co2 tax"), ("Café culture", "caf culture"), ("Ⅳ method", "iv method"), ("tax – rate (VAT)", "tax - rate (vat)"), ("－ wages －", "wages"), ("ΣΟΦΙΑ", ""), ("№ 5", "no 5")]


def label_normalization(spark, d):
    """The forms of fixed labels and of all concept labels of the canonical list."""
    x = spark.createDataFrame([r for r, _ in LABEL_CASES], "string").toDF("label").unionByName(table(spark, d, "head_concepts").select(F.col("preferred_label").alias("label")))
    return x.where("label is not null").distinct().select("label", L.normalized(F.col("label")).alias("normalized_label"))


def preferred_label(spark, d):
    return _preferred(spark, d)


def label_histograms(spark, d):
    n = table(spark, d, "nodes").where("label is not null").select(L.normalized(F.col("label")).alias("normalized_label"), F.explode(F.from_json("countries_json", "array<string>")).alias("country"))
    return O.top_values(n, "normalized_label", "country", 3).withColumn("rank", F.col("rank").cast("int"))


def head_pool_cumulative(spark, d):
    return O.head_pool(_preferred(spark, d).select("normalized_label", "instances"), 10, 0.3)


def head_rank_zscores(spark, d):
    return O.head_rank_scores(table(spark, d, "head_selection_metrics"), ["instance_count", "distinct_papers", "distinct_journals", "distinct_partners", "distinct_edge_papers"]).select("row_id", "rank_score")


def signature_candidate_pairs(spark, d):
    return O.signature_pairs(_preferred(spark, d))


def signature_unique_map(spark, d):
    return O.unique_signature_map(_preferred(spark, d), table(spark, d, "head_concepts"))


def token_shortlist(spark, d):
    tail = table(spark, d, "head_selection_metrics").where("normalized_label is not null").select("normalized_label").distinct()
    return O.token_shortlist(tail, table(spark, d, "head_concepts"), 500, 3).withColumn("rank", F.col("rank").cast("int"))


def _queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0")


def embedding_knn_top3(spark, d):
    return O.vector_neighbors(_queries(spark, d), table(spark, d, "embeddings"), 3).select("vec_id", "neighbor_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("int").alias("rank"))


def embedding_margin_decision(spark, d):
    e = table(spark, d, "embeddings")
    m = O.margin_decisions(O.vector_neighbors(_queries(spark, d), e, 12), e, 0.4, 0.3, 0.03)
    return m.select("vec_id", "label", F.round("cosine", 4).alias("cosine"), "decision")


def _lifted(spark, d):
    return O.concept_edges(table(spark, d, "edges"), table(spark, d, "instance_mappings_soft"))


def concept_edge_list(spark, d):
    return _lifted(spark, d).select("custom_id", "edge_id", "src", "dst")


def concept_edge_weights(spark, d):
    return O.concept_weights(_lifted(spark, d))


PROFILE_ATTRIBUTES = ["relationship_type", "sign", "evidence_method", "causal_presentation", "statistical_significance"]


def concept_edge_profiles(spark, d):
    return O.edge_profiles(_lifted(spark, d), PROFILE_ATTRIBUTES)


def pair_summary_signs(spark, d):
    return O.pair_signs(_lifted(spark, d))


def _family(spark, d):
    h = table(spark, d, "head_concepts")
    e = O.concept_weights(_lifted(spark, d))
    near = e.select(F.col("src").alias("id"), F.col("dst").alias("x")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("x"))).groupBy("id").agg(F.collect_set("x").alias("neighbors"))
    first = lambda df, at: df.groupBy("custom_id", "node_id").agg(F.min(F.struct("ingested_at", *at)).alias("f")).select("custom_id", "node_id", "f.*")
    n = first(table(spark, d, "nodes"), ["countries_json", "unit_of_analysis_json"])
    m = first(table(spark, d, "instance_mappings_soft"), ["concept_id"]).where("concept_id <> ''").select("custom_id", "node_id", F.col("concept_id").alias("id"))
    context = m.join(n, ["custom_id", "node_id"])
    of = lambda c: O.top_values(context.select("id", F.explode(F.from_json(c, "array<string>")).alias("value")), "id", "value", 5)
    r = table(spark, d, "manual_overrides").where("override_kind in ('merge_pair', 'block_pair')")
    reviewed = r.select(F.least("left_normalized_label", "right_normalized_label").alias("a"), F.greatest("left_normalized_label", "right_normalized_label").alias("b"), (F.col("override_kind") == "merge_pair").alias("same"))
    pairs = e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return e, O.family_scores(pairs, O.concept_profiles(h, near, of("countries_json"), of("unit_of_analysis_json")), reviewed)


def duplicate_terms(spark, d):
    """The terms of the duplicate score that SQL can state, of all concept pairs that share a claim."""
    s = _family(spark, d)[1]
    return s.select("u", "v", "lexical_overlap", "containment", "substring_share", "shared_tokens", "neighbor_overlap", "alias_overlap", F.col("protected").cast("int").alias("protected"))


def duplicate_soft_score(spark, d):
    return _family(spark, d)[1].select("u", "v", "contradiction", "reason", "duplicate_score")


def suppression_final_rank(spark, d):
    e, s = _family(spark, d)
    w = e.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("weight").alias("score"))
    ranked = w.withColumn("score", F.round("score", 6))
    return O.family_ranking(ranked, s).select("u", "v", "duplicate_score", "final_score", F.col("final_rank").cast("int").alias("final_rank"), F.col("shift").cast("int").alias("shift"))


def display_refinement(spark, d):
    return B.display_labels(table(spark, d, "instance_mappings_hard"), table(spark, d, "head_concepts"))


def abstract_quality(spark, d):
    return B.abstract_quality(table(spark, d, "works_abstracts")).distinct()


def rebuilt_abstracts(spark, d):
    kids = shred(*(table(spark, d, t) for t in ("works_base", "works_topics", "works_abstracts", "works_raw")))
    return B.rebuilt_abstracts(kids)


def works_deduplicated(spark, d):
    return B.first_delivered(table(spark, d, "works_base").select("work_id", "publication_year", "source_id"), ["work_id"], ["publication_year", "source_id"])


def works_overlay(spark, d):
    top = B.source_stats(table(spark, d, "works_base"), 20)
    return B.overlay(table(spark, d, "works_base"), top).groupBy("source_id").agg(F.count_distinct("work_id").alias("works"))


def combined_sources(spark, d):
    w = table(spark, d, "works_base")
    return B.combine_first_wins([w.where("corpus_bucket = 'core'").select("work_id", F.lit("core").alias("origin")), w.select("work_id", F.lit("any").alias("origin"))], "work_id")


def source_classes(spark, d):
    return table(spark, d, "works_base").groupBy(B.classify_source("source_display_name", "000", "00[1-5]", "journal").alias("class")).agg(F.count(F.lit(1)).alias("works"))


def extraction_qa(spark, d):
    return B.extraction_qa(table(spark, d, "edges"))


def enum_shares(spark, d):
    return B.enum_shares(table(spark, d, "edges"), ["directionality", "sign", "edge_role"])


def gate_grid(spark, d):
    return B.gate_grid(table(spark, d, "head_selection_metrics"), [1, 2, 3, 5, 10], [1, 2, 3, 5])


def source_quality_rank(spark, d):
    return B.source_ranking(B.source_stats(table(spark, d, "works_base"), 3)).withColumn("rank", F.col("rank").cast("int"))


def source_summary(spark, d):
    return B.source_summary(table(spark, d, "works_base"), table(spark, d, "works_topics"))


def mention_series(spark, d):
    return B.mention_series(table(spark, d, "documents"), "credit|lending", 1980, 2020)


def freshness_audit(spark, d):
    return B.freshness(table(spark, d, "works_base"), [2000, 2010, 2020])


def stratified_sample(spark, d):
    return B.stratified_sample(table(spark, d, "documents").select("doc_id", "doc_kind"), "doc_kind", "doc_id", 20, 100)


def search_rank(spark, d):
    return S.search_concepts(table(spark, d, "head_concepts"), "credit rationing").withColumn("rank", F.col("rank").cast("int"))


def fuzzy_title_match(spark, d):
    heads = table(spark, d, "head_concepts").select(F.col("concept_id").alias("id"), F.col("preferred_label").alias("title"))
    m = table(spark, d, "head_selection_metrics").select(F.col("row_id").alias("id"), F.col("normalized_label").alias("title"))
    return S.title_matches(m, heads)


def question_filter(spark, d):
    return S.question_filter(table(spark, d, "works_base"), "Credit", ["display_name", "source_display_name"]).select("work_id").distinct()


def event_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (label_signatures, label_normalization, preferred_label, label_histograms, head_pool_cumulative, head_rank_zscores, signature_candidate_pairs, signature_unique_map, token_shortlist, embedding_knn_top3, embedding_margin_decision, concept_edge_list, concept_edge_weights, concept_edge_profiles, pair_summary_signs, duplicate_terms, duplicate_soft_score, suppression_final_rank, display_refinement, abstract_quality, rebuilt_abstracts, works_deduplicated, works_overlay, combined_sources, source_classes, extraction_qa, enum_shares, gate_grid, source_quality_rank, source_summary, mention_series, freshness_audit, stratified_sample, search_rank, fuzzy_title_match, question_filter, event_windows)}

# ---------------------------------------------------------------- SQL


def _norm(x):
    return rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({x}, '[–—−]', '-', 'g'), '&', ' and ', 'g')), '[^0-9a-z()\-\s]+', ' ', 'g'), '\s+', ' ', 'g'), '^[ \-]+|[ \-]+$', '', 'g')"


def _bare(x):
    return rf"regexp_replace({x}, '\s*\([A-Za-z][A-Za-z0-9&/\-]{{1,14}}\)\s*$', '')"


def _plain(x):
    return rf"trim(regexp_replace(regexp_replace({x}, '[^0-9a-z\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


_SING = "array_to_string(list_transform(string_split({x}, ' '), lambda t: CASE WHEN length(t) <= 4 OR t LIKE '%ics' THEN t WHEN t LIKE '%ies' AND length(t) > 5 THEN substr(t, 1, length(t) - 3) || 'y' WHEN t LIKE '%ss' OR t NOT LIKE '%s' OR t LIKE '%us' OR t LIKE '%is' THEN t ELSE substr(t, 1, length(t) - 1) END), ' ')"
_STOPS = ", ".join(f"'{w}'" for w in L.STOPWORDS)


def _sigs(x):
    n = _norm(x)
    words = f"list_filter(string_split({_plain(_bare(n))}, ' '), lambda w: w <> '' AND w NOT IN ({_STOPS}))"
    return {
        "normalized_label": n, "no_paren_signature": _bare(n), "punctuation_signature": _plain(_bare(n)), "singular_signature": _SING.format(x=_plain(_bare(n))),
        "paren_acronym": "coalesce(" + _norm(rf"regexp_extract({x}, '\s*\(([A-Z][A-Z0-9&/\-]{{1,14}})\)\s*$', 1)") + ", '')",
        "initialism_signature": f"CASE WHEN len({words}) BETWEEN 2 AND 8 THEN array_to_string(list_transform({words}, lambda w: substr(w, 1, 1)), '') ELSE '' END",
    }


def _tokens(x):
    return f"list_distinct(list_filter(string_split({_plain(_norm(_bare(x)))}, ' '), lambda w: w <> ''))"


_PREF = f"""counts AS (SELECT {_norm('label')} AS normalized_label, label AS raw, count(*) AS n FROM nodes WHERE label IS NOT NULL GROUP BY ALL),
pref AS (SELECT normalized_label, (min({{'a': -n, 'b': length(raw), 'r': raw}})).r AS preferred_label, CAST(sum(n) AS BIGINT) AS instances FROM counts WHERE normalized_label <> '' GROUP BY 1),
"""
_SIG_ROWS = "SELECT {cols}, kind, signature FROM (SELECT {cols}, unnest([" + ", ".join("'{}'".format(k) for k in _sigs("x")) + "]) AS kind, unnest([{sigs}]) AS signature FROM {t})"


def _sig_rows(cols, t):
    return _SIG_ROWS.format(cols=cols, t=t, sigs=", ".join(_sigs("preferred_label").values()))


_EVIDENCE = "round(CAST(count(*) AS DOUBLE) + 0.25 * max(CAST(coalesce(uses_data >= 1, false) AS INT)) + 0.25 * max(CAST(coalesce(causal_presentation IN ('explicit_causal', 'implicit_causal'), false) AS INT)) + 0.10 * max(CAST(coalesce(statistical_significance = 'significant', false) AS INT)) + 0.10 * max(CAST(coalesce(evidence_method NOT IN ('do_not_know', 'other'), true) AS INT)), 6)"
_LIFT = """first_map AS (SELECT custom_id, node_id, (min({'t': ingested_at, 'c': concept_id})).c AS concept_id FROM instance_mappings_soft GROUP BY ALL),
first_edge AS (SELECT custom_id, edge_id, min({'t': ingested_at, 'a': source_node_id, 'b': target_node_id, 'r': relationship_type, 's': sign, 'u': uses_data, 'c': causal_presentation, 'g': statistical_significance, 'm': evidence_method, 'cs': claim_status, 'ex': explicitness, 'te': tentativeness}) AS f FROM edges GROUP BY ALL),
lifted AS (SELECT e.custom_id, e.edge_id, s.concept_id AS src, t.concept_id AS dst, f.r AS relationship_type, f.s AS sign, f.u AS uses_data, f.c AS causal_presentation, f.g AS statistical_significance, f.m AS evidence_method, f.cs AS claim_status, f.ex AS explicitness, f.te AS tentativeness
  FROM first_edge e JOIN first_map s ON s.custom_id = e.custom_id AND s.node_id = f.a JOIN first_map t ON t.custom_id = e.custom_id AND t.node_id = f.b WHERE s.concept_id <> '' AND t.concept_id <> '' AND s.concept_id <> t.concept_id),
cw AS (SELECT src, dst, {_EVIDENCE} AS weight, count(*) AS n, count(DISTINCT custom_id) AS papers FROM lifted GROUP BY ALL),
""".replace("{_EVIDENCE}", _EVIDENCE)
_W = "WITH "
_Z = "z AS (SELECT 1)\n"
_NAMES = "list_concat([coalesce(preferred_label, '')], list_filter(coalesce(from_json(aliases_json, '[\"VARCHAR\"]'), []), lambda x: x IS NOT NULL AND trim(x) <> ''))"
_DUP = _LIFT + "nbr AS (SELECT id, list_distinct(list(x)) AS nb FROM (SELECT src AS id, dst AS x FROM cw UNION ALL SELECT dst, src FROM cw) GROUP BY 1),\nnames AS (SELECT concept_id AS id, coalesce(preferred_label, '') AS raw, unnest(" + _NAMES + ") AS name FROM head_concepts),\nsg AS (SELECT id, raw, " + _tokens("name") + " AS tk, " + ", ".join(f"{v} AS {k}" for k, v in _sigs("name").items()) + " FROM names),\nprof AS (SELECT id, " + _norm("min(raw)") + " AS label, list_distinct(flatten(list(tk))) AS tk, " + ", ".join(f"list_filter(list_distinct(list({k})), lambda x: x <> '') AS {k}" for k in _sigs("name")) + ", coalesce(any_value(nb), []) AS nb FROM sg LEFT JOIN nbr USING (id) GROUP BY id),\nprs AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM cw),\n" + f"""m AS (SELECT u, v, a.label AS la, b.label AS lb, a.tk AS ta, b.tk AS tb, len(list_intersect(a.tk, b.tk)) AS sh, len(list_distinct(list_concat(a.tk, b.tk))) AS un, len(list_intersect(a.nb, b.nb)) AS ns, len(list_distinct(list_concat(a.nb, b.nb))) AS nu,
  CASE WHEN list_has_any(a.normalized_label, b.normalized_label) OR list_has_any(a.no_paren_signature, b.no_paren_signature) THEN 1.0 WHEN list_has_any(a.punctuation_signature, b.punctuation_signature) OR list_has_any(a.singular_signature, b.singular_signature) THEN 0.8
    WHEN list_has_any(a.paren_acronym, b.paren_acronym) OR list_has_any(a.initialism_signature, b.initialism_signature) THEN 0.6 ELSE 0.0 END AS alias_overlap FROM prs JOIN prof a ON a.id = u JOIN prof b ON b.id = v),
dup AS (SELECT u, v, round(CASE WHEN un > 0 THEN sh / un ELSE 0 END, 6) AS lexical_overlap, round(CASE WHEN least(len(ta), len(tb)) > 0 THEN sh / least(len(ta), len(tb)) ELSE 0 END, 6) AS containment,
  round(CASE WHEN la <> '' AND lb <> '' AND (contains(la, lb) OR contains(lb, la)) THEN least(length(la), length(lb)) / greatest(length(la), length(lb)) ELSE 0 END, 6) AS substring_share,
  round(CASE WHEN sh >= 2 THEN sh / greatest(least(len(ta), len(tb)), 1) ELSE 0 END, 6) AS shared_tokens, round(CASE WHEN nu > 0 THEN ns / nu ELSE 0 END, 6) AS neighbor_overlap, CAST(alias_overlap AS DOUBLE) AS alias_overlap,
  CAST({" OR ".join(f"(len(list_intersect(ta, {g})) > 0 AND len(list_intersect(tb, {g})) > 0 AND list_sort(list_intersect(ta, {g})) <> list_sort(list_intersect(tb, {g})))" for g in map(str, L.CONTRASTS))} OR (least(la, lb) = 'inflation' AND greatest(la, lb) = 'inflation expectations') AS INT) AS protected FROM m),
"""
_COS = "sims AS (SELECT q.vec_id, b.vec_id AS neighbor_id, b.label, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings q, embeddings b WHERE q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id),\n"
_Q = "credit rationing"
_SCORE = "max(CASE WHEN lower(n) = 'credit rationing' THEN 100.0 WHEN starts_with(lower(n), 'credit rationing') THEN 60.0 WHEN contains(lower(n), 'credit rationing') THEN 40.0 ELSE 0 END + 20.0 * (CAST(contains(lower(n), 'credit') AS INT) + CAST(contains(lower(n), 'rationing') AS INT)) / 2)"

ORACLES = {
    "label_normalization": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LABEL_CASES) + f") v(label, normalized_label) UNION SELECT preferred_label, {_norm('preferred_label')} FROM head_concepts WHERE preferred_label IS NOT NULL",
    "label_signatures": "SELECT DISTINCT label, " + ", ".join(f"{v} AS {k}" for k, v in _sigs("label").items()) + " FROM nodes WHERE label IS NOT NULL",
    "preferred_label": _W + _PREF + _Z + "SELECT * FROM pref",
    "label_histograms": f"SELECT normalized_label, country, count(*) AS n, CAST(row_number() OVER (PARTITION BY normalized_label ORDER BY count(*) DESC, country) AS INT) AS rank FROM (SELECT {_norm('label')} AS normalized_label, unnest(from_json(countries_json, '[\"VARCHAR\"]')) AS country FROM nodes WHERE label IS NOT NULL) WHERE country <> '' GROUP BY 1, 2 QUALIFY rank <= 3",
    "head_pool_cumulative": _W + _PREF + "o AS (SELECT *, coalesce(sum(instances) OVER (ORDER BY instances DESC, normalized_label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(instances) OVER () AS share FROM pref),\n" + _Z + "SELECT normalized_label, instances, round(share, 6) AS share_before FROM o WHERE instances >= 10 OR share < 0.3",
    "head_rank_zscores": "SELECT row_id, round(" + " + ".join(f"(ln(1 + coalesce({c}, 0)) - avg(ln(1 + coalesce({c}, 0))) OVER ()) / stddev_pop(ln(1 + coalesce({c}, 0))) OVER ()" for c in ("instance_count", "distinct_papers", "distinct_journals", "distinct_partners", "distinct_edge_papers")) + ", 6) AS rank_score FROM head_selection_metrics",
    "signature_candidate_pairs": _W + _PREF + "sig AS (" + _sig_rows("normalized_label, instances", "pref") + " WHERE kind <> 'normalized_label' AND signature <> '' AND signature <> normalized_label),\nanc AS (SELECT kind, signature, (min({'a': -instances, 'l': normalized_label})).l AS anchor FROM sig GROUP BY 1, 2),\n" + _Z + "SELECT least(anchor, normalized_label) AS left_label, greatest(anchor, normalized_label) AS right_label, count(DISTINCT kind) AS signatures FROM sig JOIN anc USING (kind, signature) WHERE anchor <> normalized_label GROUP BY 1, 2",
    "signature_unique_map": _W + _PREF + "hs AS (SELECT kind, signature, min(concept_id) AS concept_id FROM (" + _sig_rows("concept_id", "head_concepts") + ") WHERE signature <> '' GROUP BY 1, 2 HAVING count(DISTINCT concept_id) = 1),\nls AS (" + _sig_rows("normalized_label", "pref") + " WHERE signature <> ''),\n" + _Z + "SELECT normalized_label, min(concept_id) AS concept_id FROM ls JOIN hs USING (kind, signature) GROUP BY 1 HAVING count(DISTINCT concept_id) = 1",
    "token_shortlist": _W + f"tt AS (SELECT DISTINCT normalized_label, unnest({_tokens('normalized_label')}) AS token FROM head_selection_metrics WHERE normalized_label IS NOT NULL),\nht AS (SELECT concept_id, unnest({_tokens('preferred_label')}) AS token FROM head_concepts),\nrare AS (SELECT token FROM ht GROUP BY 1 HAVING count(*) <= 500),\nsh AS (SELECT normalized_label, concept_id, count(*) AS shared FROM tt JOIN ht USING (token) JOIN rare USING (token) GROUP BY ALL),\nj AS (SELECT *, round(shared / ((SELECT count(*) FROM ht h WHERE h.concept_id = sh.concept_id) + (SELECT count(*) FROM tt t WHERE t.normalized_label = sh.normalized_label) - shared), 6) AS jaccard FROM sh),\n" + _Z + "SELECT normalized_label, concept_id, shared, jaccard, CAST(row_number() OVER (PARTITION BY normalized_label ORDER BY jaccard DESC, concept_id) AS INT) AS rank FROM j QUALIFY rank <= 3",
    "embedding_knn_top3": _W + _COS + _Z + "SELECT vec_id, neighbor_id, round(cosine, 4) AS cosine, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbor_id) AS INT) AS rank FROM sims QUALIFY rank <= 3",
    "embedding_margin_decision": _W + _COS + """t12 AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbor_id) <= 12),
per AS (SELECT vec_id, label, max(cosine) AS best, row_number() OVER (PARTITION BY vec_id ORDER BY max(cosine) DESC, label) AS r FROM t12 GROUP BY 1, 2),
g AS (SELECT vec_id, max(CASE WHEN r = 1 THEN label END) AS label, max(CASE WHEN r = 1 THEN best END) AS top, coalesce(max(CASE WHEN r = 2 THEN best END), 0) AS second FROM per GROUP BY 1),
""" + _Z + "SELECT vec_id, label, round(top, 4) AS cosine, CASE WHEN top >= 0.4 AND round(top - second, 6) >= 0.03 THEN 'accepted' WHEN top >= 0.3 OR round(top - second, 6) >= 0.03 THEN 'review' ELSE 'rejected' END AS decision FROM g",
    "concept_edge_list": _W + _LIFT + _Z + "SELECT custom_id, edge_id, src, dst FROM lifted",
    "concept_edge_weights": _W + _LIFT + _Z + "SELECT * FROM cw",
    "concept_edge_profiles": _W + _LIFT + _Z + "SELECT src, dst, attribute, value, count(*) AS n FROM (SELECT src, dst, unnest(['relationship_type', 'sign', 'evidence_method', 'causal_presentation', 'statistical_significance']) AS attribute, coalesce(unnest([relationship_type, sign, evidence_method, causal_presentation, statistical_significance]), 'NA') AS value FROM lifted) GROUP BY ALL",
    "pair_summary_signs": _W + _LIFT + _Z + "SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS claims, count(*) FILTER (src < dst) AS forward, count(DISTINCT custom_id) AS papers, round((count(*) FILTER (sign = 'increase') - count(*) FILTER (sign = 'decrease')) / nullif(count(*) FILTER (sign IN ('increase', 'decrease', 'no_effect')), 0), 6) AS net_sign FROM lifted GROUP BY 1, 2",
    "duplicate_terms": _W + _DUP + _Z + "SELECT u, v, lexical_overlap, containment, substring_share, shared_tokens, neighbor_overlap, alias_overlap, protected FROM dup",
    "display_refinement": """WITH n AS (SELECT concept_id, normalized_label, count(*) AS n FROM instance_mappings_hard WHERE concept_id <> '' AND normalized_label IS NOT NULL GROUP BY ALL),
b AS (SELECT *, n / sum(n) OVER (PARTITION BY concept_id) AS s FROM n QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY n DESC, normalized_label) = 1)
SELECT h.concept_id, CASE WHEN coalesce(s >= 0.42, false) THEN normalized_label ELSE preferred_label END AS display_label, round(s, 6) AS share FROM head_concepts h LEFT JOIN b USING (concept_id)""",
    "abstract_quality": r"""WITH x AS (SELECT work_id, trim(regexp_replace(coalesce(abstract_text, ''), '\s+', ' ', 'g')) AS t FROM works_abstracts),
y AS (SELECT work_id, t, lower(t) AS l, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS w, length(t) - length(replace(t, ';', '')) AS s, len(regexp_extract_all(t, '[A-Za-z0-9]+')) AS k FROM x),
q AS (SELECT work_id, w AS words, CASE WHEN w = 0 THEN 'missing' WHEN l IN ('none', 'none.', 'not available', 'n/a') THEN 'placeholder'
  WHEN contains(l, 'an abstract is not available') OR contains(l, 'abstract is not available') OR contains(l, 'no abstract available') OR contains(l, 'please use the get access link') OR contains(l, 'for information on how to access this content') OR contains(l, 'preview has been provided') THEN 'placeholder'
  WHEN w < 20 AND (contains(l, 'clinicaltrials.gov identifier') OR contains(l, 'trial registration') OR contains(l, 'registration number') OR contains(l, 'funded by') OR contains(l, 'supported by')) THEN 'metadata_only'
  WHEN w < 20 AND k <= 8 AND NOT contains(t, '.') AND NOT contains(t, ':') THEN 'metadata_only' WHEN w < 25 AND s >= 2 THEN 'keyword_list' WHEN w < 20 THEN 'too_short' WHEN w < 30 THEN 'borderline_short' WHEN w < 50 THEN 'usable_short' ELSE 'usable' END AS quality FROM y)
SELECT DISTINCT work_id, words, quality, CAST(quality IN ('usable', 'usable_short') AS INT) AS has_abstract, CAST(quality IN ('usable', 'usable_short') AS INT) AS ready FROM q""",
    "works_deduplicated": "SELECT work_id, f.y AS publication_year, f.s AS source_id FROM (SELECT work_id, list_sort(list({'y': publication_year, 's': source_id}), 'ASC', 'NULLS FIRST')[1] AS f FROM works_base GROUP BY 1)",
    "works_overlay": "SELECT source_id, count(DISTINCT work_id) AS works FROM works_base WHERE source_id IN (SELECT source_id FROM works_base WHERE source_id IS NOT NULL GROUP BY source_id, corpus_bucket HAVING count(*) >= 20) GROUP BY 1",
    "combined_sources": "SELECT work_id, CASE WHEN coalesce(bool_or(corpus_bucket = 'core'), false) THEN 'core' ELSE 'any' END AS origin FROM works_base GROUP BY 1",
    "source_classes": "SELECT CASE WHEN contains(n, '000') THEN 'exclude' WHEN regexp_matches(n, '00[1-5]') THEN 'adjacent' WHEN contains(n, 'journal') THEN 'core' ELSE 'review' END AS class, count(*) AS works FROM (SELECT lower(coalesce(source_display_name, '')) AS n FROM works_base) GROUP BY 1",
    "extraction_qa": "SELECT count(*) AS papers, round(avg(n), 6) AS mean_edges, round(quantile_cont(n, 0.5), 6) AS median_edges, round(quantile_cont(n, 0.9), 6) AS p90_edges FROM (SELECT custom_id, count(DISTINCT edge_id) AS n FROM edges GROUP BY 1)",
    "enum_shares": "SELECT attribute, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY attribute), 6) AS share FROM (SELECT unnest(['directionality', 'sign', 'edge_role']) AS attribute, coalesce(unnest([directionality, sign, edge_role]), 'NA') AS value FROM edges) GROUP BY 1, 2",
    "gate_grid": "SELECT CAST(s AS INT) AS least_support, CAST(p AS INT) AS least_papers, count(*) FILTER (instance_count >= s AND distinct_papers >= p) AS labels, CAST(coalesce(sum(instance_count) FILTER (instance_count >= s AND distinct_papers >= p), 0) AS BIGINT) AS instances, round(coalesce(sum(instance_count) FILTER (instance_count >= s AND distinct_papers >= p), 0) / sum(instance_count), 6) AS share FROM head_selection_metrics, (SELECT unnest([1, 2, 3, 5, 10]) AS s), (SELECT unnest([1, 2, 3, 5]) AS p) GROUP BY 1, 2",
    "source_quality_rank": """WITH s AS (SELECT source_id, corpus_bucket, count(*) AS works, coalesce(avg(fwci), 0) AS f, coalesce(avg(cited_by_count), 0) AS c FROM works_base WHERE source_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
z AS (SELECT *, round(CASE WHEN coalesce(stddev_pop(f) OVER w, 0) <= 1e-12 THEN 0 ELSE (f - avg(f) OVER w) / stddev_pop(f) OVER w END + CASE WHEN coalesce(stddev_pop(c) OVER w, 0) <= 1e-12 THEN 0 ELSE (c - avg(c) OVER w) / stddev_pop(c) OVER w END, 6) AS quality FROM s WHERE corpus_bucket IS NOT NULL WINDOW w AS (PARTITION BY corpus_bucket))
SELECT source_id, corpus_bucket, works, quality, CAST(row_number() OVER (PARTITION BY corpus_bucket ORDER BY quality DESC, source_id) AS INT) AS rank FROM z""",
    "source_summary": """WITH f AS (SELECT work_id, list_sort(list({'s': source_id, 'y': publication_year}), 'ASC', 'NULLS FIRST')[1] AS f FROM works_base GROUP BY 1),
w AS (SELECT work_id, f.s AS source_id, f.y AS publication_year FROM f WHERE f.s IS NOT NULL),
n AS (SELECT source_id, subfield_id, count(*) AS n FROM (SELECT DISTINCT work_id, subfield_id FROM works_topics WHERE subfield_id <> '') JOIN w USING (work_id) GROUP BY ALL),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY n DESC, subfield_id) <= 3)
SELECT w.source_id, count(*) AS works, min(publication_year) AS first_year, max(publication_year) AS last_year, (SELECT string_agg(subfield_id, '|' ORDER BY n DESC, subfield_id) FROM t WHERE t.source_id = w.source_id) AS subfields FROM w GROUP BY w.source_id""",
    "mention_series": """WITH p AS (SELECT publication_year AS year, count(*) AS docs, count(*) FILTER (regexp_matches(lower(text), 'credit|lending')) AS hits FROM documents GROUP BY 1),
s AS (SELECT CAST(y AS INT) AS year, coalesce(docs, 0) AS docs, coalesce(hits, 0) AS hits FROM (SELECT unnest(range(1980, 2021)) AS y) LEFT JOIN p ON p.year = y),
t AS (SELECT *, CASE WHEN docs > 0 THEN hits / docs ELSE 0 END AS share FROM s)
SELECT year, docs, hits, round(share, 6) AS share, round(avg(share) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rolling, median(hits) OVER (ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS median_before FROM t""",
    "freshness_audit": "SELECT max(updated_date) AS last_update, count(*) AS rows, " + ", ".join(f"count(*) FILTER (publication_year = {y}) AS works_{y}" for y in (2000, 2010, 2020)) + " FROM works_base",
    "search_rank": f"SELECT concept_id, preferred_label, instance_support, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY round(s, 6) DESC, instance_support DESC, concept_id) AS INT) AS rank FROM (SELECT concept_id, preferred_label, instance_support, {_SCORE} AS s FROM (SELECT concept_id, preferred_label, instance_support, unnest(list_concat([preferred_label], coalesce(from_json(aliases_json, '[\"VARCHAR\"]'), []))) AS n FROM head_concepts) GROUP BY ALL) WHERE s > 0 QUALIFY rank <= 8",
    "fuzzy_title_match": f"""WITH a AS (SELECT row_id AS id, {_tokens('normalized_label')} AS t FROM head_selection_metrics WHERE normalized_label IS NOT NULL), b AS (SELECT concept_id AS id, {_tokens('preferred_label')} AS t FROM head_concepts WHERE preferred_label IS NOT NULL),
j AS (SELECT a.id AS left_id, b.id AS right_id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS overlap FROM a, b WHERE len(list_intersect(a.t, b.t)) > 0)
SELECT left_id, right_id, overlap FROM j WHERE overlap >= 0.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY overlap DESC, right_id) = 1""",
    "question_filter": "SELECT DISTINCT work_id FROM works_base WHERE contains(lower(coalesce(display_name, '')), 'credit') OR contains(lower(coalesce(source_display_name, '')), 'credit')",
    "event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
