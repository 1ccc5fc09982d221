"""Graph features of missing links: co-occurrence gaps, two- and three-hop path support, local motifs.

The fan-out of each mediator is cut to its strongest neighbours *before* the self-join (a rank filter that Spark pushes below the
shuffle), so a hub with a third of all edges contributes at most n x n rows.  Paths and motifs share one self-join, and observed edges enter the
aggregation as marked rows, so what they rule out needs no join of its own: rows of two hops are shuffled once, combined map-side.

``by`` names columns that part the claims into independent graphs (as one per cutoff year), worked on in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.claims import until
from ..plans.scratch import Scratch, free_shuffles
from ..plans.skew import hot_keys, salted_join, topn_per_key
from .three_hops import three_hops

#: Rows that one task of ``link_classes`` adds up, about.
TASK_ROWS = 1_000_000
#: Kinds of its rows.
HOP, EDGE, PAPER, WANTED = range(4)
#: Two-hop ends of the start nodes of one block of ``support_3``, about.
BLOCK_ENDS = 2_000_000
#: Papers with more concepts than this spread their pairs over tasks.
MANY_CONCEPTS = 2000


def edge_aggregate(claims: DataFrame, cutoff: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per directed edge: summed weight and number of claims (combined map-side)."""
    return until(claims, cutoff).groupBy(*by, "src", "dst").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def node_degree(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct in-neighbours plus distinct out-neighbours per node."""
    ends = edges.select(*by, F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(*by, F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy(*by, "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def gap_bonus(cooc_count: Column, tau: int) -> Column:
    """Gap of a pair below ``tau`` papers, 0 to 1."""
    return F.least(F.greatest((tau - cooc_count) / max(tau, 1), F.lit(0.0)), F.lit(1.0))


def _papers(claims: DataFrame, by: Sequence[str]) -> DataFrame:
    """(paper_id, year, codes): smallest year and distinct concepts per paper, sorted."""
    member = claims.select(*by, "paper_id", "year", F.explode(F.array("src", "dst")).alias("code"))
    return member.groupBy(*by, "paper_id").agg(F.min("year").alias("year"), F.array_sort(F.collect_set("code")).alias("codes"))


def underexplored_pairs(claims: DataFrame, tau: int = 2, cutoff: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Concepts of one paper in unordered pairs (u < v): papers with both, first and last year, gap below ``tau``.

    A paper's year is its smallest row year; papers whose only claims are self-loops have no pair.  All pairs of a paper are the result itself; what
    is gathered per paper is its distinct concepts, never its rows, and the pairs of a paper with very many concepts are spread over tasks by their first concept.
    """
    paper = _papers(until(claims, cutoff), by)
    first = lambda df: df.select(*by, "year", "codes", F.posexplode("codes").alias("k", "u"))
    rows = first(paper.where(F.size("codes") <= MANY_CONCEPTS)).unionByName(first(paper.where(F.size("codes") > MANY_CONCEPTS)).repartition("u"))
    pairs = rows.select(*by, "year", "u", F.explode(F.expr("slice(codes, k + 2, size(codes))")).alias("v"))
    out = pairs.groupBy(*by, "u", "v").agg(F.count(F.lit(1)).alias("cooc_count"), F.min("year").alias("first_year_seen"), F.max("year").alias("last_year_seen"))
    return out.withColumn("gap_bonus", gap_bonus(F.col("cooc_count"), tau)).withColumn("underexplored", F.col("cooc_count") < tau)


def _strongest(edges: DataFrame, end: str, other: str, order: str, n: int, by: Sequence[str]) -> DataFrame:
    return topn_per_key(edges, [*by, end], [F.desc(order), F.asc(other)], n)


def _sides(edges: DataFrame, n: int, paths: bool, motifs: bool, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Edges into (u, columns with ``a``) and out of (v, columns with ``b``) each mediator w, cut to the strongest ``n`` of a kind; the latter with the discount of w."""
    kinds = [k for k, on in (("weight", paths), ("n", motifs)) if on]

    def side(end: str, other: str, name: str, tag: str) -> DataFrame:
        parts = [_strongest(edges, end, other, k, n, by).select(*by, F.col(end).alias("w"), F.col(other).alias(name), "weight", "n", *[F.lit(int(k == x)).alias(f"_{x}") for x in ("weight", "n")]) for k in kinds]
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).groupBy(*by, "w", name).agg(*[F.max(c).alias(c) for c in ("weight", "n", "_weight", "_n")])
        return out.select(*by, "w", name, *[F.col(c).alias(f"{tag}{c}") for c in ("weight", "n", "_weight", "_n")])

    degree = node_degree(edges, by).select(*by, F.col("node").alias("w"), (1 / (1 + F.log1p("degree"))).alias("disc"))
    return side("dst", "src", "u", "a"), side("src", "dst", "v", "b").join(degree, [*by, "w"])


def _hop_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """What a row u -> w -> v adds to the features of its link."""
    path, motif = (F.col("a_weight") * F.col("b_weight")), (F.col("a_n") * F.col("b_n"))
    both = F.col("aweight") * F.col("bweight") * path
    return rows.select(*keys, (both * F.col("disc")).alias("path_support_raw"), (both * (1 - F.col("disc"))).alias("hub_penalty"), path.cast("long").alias("mediator_count"), (F.sqrt(F.col("an") * F.col("bn")) * motif).alias("motif_bonus_raw"), motif.cast("long").alias("motif_count"))


def hop_rows(edges: DataFrame, n: int, paths: bool = True, motifs: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """u -> w -> v rows, loops left out: (u, w, v, path_support_raw, hub_penalty, mediator_count, motif_bonus_raw, motif_count).

    Both sides are cut to the strongest ``n`` per mediator, by weight for paths and by number of claims for motifs; a row counts for a kind if
    both its edges are within the cut of that kind.  Hubs are discounted by 1 / (1 + log(1 + degree)).
    """
    a, b = _sides(edges, n, paths, motifs, by)
    return _hop_sums(a.join(b, [*by, "w"]).where("u <> v"), *by, "u", "w", "v").where("mediator_count + motif_count > 0")


SUMS = {"path_support_raw": 0.0, "mediator_count": 0, "hub_penalty": 0.0, "motif_count": 0, "motif_bonus_raw": 0.0}


def link_rows(edges: DataFrame, n: int, paths: bool = True, motifs: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Rows (u, v, sums..., observed) that add up to the features of missing links: those of two hops, and the observed edges as marks."""
    known = edges.select(*by, F.col("src").alias("u"), F.col("dst").alias("v"), *[F.lit(z).cast("double" if z == 0.0 and isinstance(z, float) else "long").alias(c) for c, z in SUMS.items()], F.lit(1).alias("observed"))
    return hop_rows(edges, n, paths, motifs, by).select(*by, "u", "v", *SUMS, F.lit(0).alias("observed")).unionByName(known)


def link_classes(claims: DataFrame, edges: DataFrame, wanted: DataFrame, n: int, tau: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Counts ``links`` of the ordered pairs (u, v) that are wanted, edges, of one paper or of two hops, by what they have in common: (u, v, gap_bonus, observed, candidate, path_support_raw,
    hub_penalty, motif_bonus_raw, links).  u and v are null except for the pairs ``wanted`` (u, v), which have a row each; gap_bonus is null for pairs of no paper.

    For ranks among all links: what would be a row per link stays inside its task.  Two hops are shuffled once, as a list of ends per edge into the mediator, all to the
    tasks of their u; only a u that is hot has its ends spread over tasks.  Most links have a single mediator, so their features repeat; where they don't, there is a row per link.
    """
    by, start, ends = list(by), ["aweight", "an", "a_weight", "a_n", "disc"], {"bweight": "double", "bn": "long", "b_weight": "int", "b_n": "int"}
    a, b = _sides(edges, n, True, True, by)
    lists = b.groupBy(*by, "w", "disc").agg(F.collect_list(F.struct("v", *ends)).alias("e")).select(*by, "w", "disc", *[F.col(f"e.{c}").alias(c) for c in ("v", *ends)])
    hops = a.join(lists, [*by, "w"]).select(*by, "u", F.lit(HOP).alias("kind"), "v", F.struct(*start, *ends).alias("x"))

    def marks(df: DataFrame, kind: Column, u: str, v: Column) -> DataFrame:
        return df.select(*by, F.col(u).alias("u"), kind.alias("kind"), v.alias("v"), F.lit(None).cast(hops.schema["x"].dataType).alias("x"))

    pairs = _papers(claims, by).select(*by, "codes", F.explode("codes").alias("u"))
    rows = hops
    for part in (marks(edges, F.lit(EDGE), "src", F.array("dst")), marks(pairs, F.lit(PAPER), "u", F.col("codes")), marks(wanted, F.lit(WANTED), "u", F.array("v"))):
        rows = rows.unionByName(part)
    zipped = F.arrays_zip("v", *[F.coalesce(F.col(f"x.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in ends.items()])
    single = lambda df, *more: df.select(*by, "u", *more, "kind", *[F.col(f"x.{c}").alias(c) for c in start], F.inline(zipped)).where("u <> v")
    hot = hot_keys(claims.select(F.explode(F.array("src", "dst")).alias("u")), "u")
    rows = rows.withColumn("_salt", F.lit(0))
    if hot:
        x = F.when(F.col("kind") == HOP, F.struct(*start, *[F.array(c).alias(c) for c in ends]))
        many = single(rows.where(F.col("u").isin(hot))).select(*by, "u", "kind", F.array("v").alias("v"), x.alias("x"), F.pmod(F.xxhash64("v"), F.lit(32)).cast("int").alias("_salt"))
        rows = rows.where(~F.col("u").isin(hot)).unionByName(many)
    in_out = node_degree(edges, by).agg(F.sum(F.least("in_degree", F.lit(2 * n)) * F.least("out_degree", F.lit(2 * n)))).first()[0] or 0
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), in_out // TASK_ROWS)
    rows = single(rows.repartition(tasks, *by, "u", "_salt"), "_salt")
    is_ = lambda kind: (F.col("kind") == kind).cast("int")
    rows = _hop_sums(rows, *by, "u", "v", "_salt", is_(EDGE).alias("observed"), is_(PAPER).alias("paper"), is_(WANTED).alias("wanted"))
    sums = ["path_support_raw", "hub_penalty", "motif_bonus_raw"]
    rows = rows.withColumn("linked", (F.coalesce("mediator_count", F.lit(0)) + F.coalesce("motif_count", F.lit(0)) > 0).cast("int")).where("observed + paper + wanted + linked > 0")
    links = rows.groupBy(*by, "u", "_salt", "v").agg(*[F.max(c).alias(c) for c in ("observed", "wanted", "linked")], F.sum("paper").alias("papers"), *[F.sum(F.when(F.col("observed") + F.col("paper") > 0, 0.0).otherwise(F.col(c))).alias(c) for c in sums])
    links = links.withColumn("gap_bonus", F.when(F.col("papers") > 0, gap_bonus(F.col("papers"), tau)))
    missing = F.col("observed") == 0
    links = links.withColumns({c: F.when(missing, F.col(c)).otherwise(0.0) for c in sums})
    candidate = ((missing & (F.col("linked") == 1)) | (F.coalesce("gap_bonus", F.lit(0.0)) > 0)) & ((F.coalesce("gap_bonus", F.lit(1.0)) > 0) | (F.coalesce("path_support_raw", F.lit(0.0)) > 0) | (F.coalesce("motif_bonus_raw", F.lit(0.0)) > 0))
    links = links.select(*by, *[F.when(F.col("wanted") == 1, F.col(c)).alias(c) for c in ("u", "v")], "gap_bonus", "observed", candidate.cast("int").alias("candidate"), *sums)
    return links.groupBy(*links.columns).agg(F.count(F.lit(1)).alias("links"))


def _links(claims: DataFrame, cutoff: int | None, n: int, paths: bool, motifs: bool) -> DataFrame:
    edges = Scratch(claims.sparkSession, "links").write(edge_aggregate(claims, cutoff), "edges")  # read for both ends, degrees and marks
    return link_rows(edges, n, paths, motifs).groupBy("u", "v").agg(F.max("observed").alias("observed"), *[F.sum(c).alias(c) for c in SUMS]).where("observed = 0")


def support_3(claims: DataFrame, cutoff: int | None = None, n: int | None = 30) -> DataFrame:
    """(u, v, paths, support, penalty) of the three-hop paths over the strongest ``n`` (at most 30) successors of each node, or over all of them (None), per missing link.

    Nearly every path has a pair of its own, so pairs are neither shuffled nor written: start nodes are cut into blocks by ranges of their code, each block gets the
    successors of what it reaches, once however many of its paths lead there, and adds up its paths inside its task (``three_hops``).
    """
    spark, n = claims.sparkSession, n and min(n, 30)
    scratch = Scratch(spark, "links")
    edges = scratch.write(edge_aggregate(claims, cutoff), "edges")
    free_shuffles(spark)
    degree = node_degree(edges)
    ends = degree.agg(F.sum(F.col("in_degree") * (F.least("out_degree", F.lit(n)) if n else F.col("out_degree")))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ends // BLOCK_ENDS + 1)
    top = _strongest(edges, "src", "dst", "weight", n, ()) if n else edges
    lists = top.groupBy("src").agg(F.collect_list(F.struct("dst", F.col("weight").cast("double").alias("w"))).alias("e")).join(degree.select(F.col("node").alias("src"), (1 + F.log1p("degree")).alias("h")), "src")
    lists = scratch.write(lists.select("src", "h", F.col("e.dst").alias("dsts"), F.col("e.w").alias("weights")).repartitionByRange(blocks, "src").withColumn("block", F.spark_partition_id()), "lists")
    free_shuffles(spark)
    near = lists.select("block", F.explode("dsts").alias("src")).distinct().join(lists.select("src", "dsts"), "src")
    reached = near.repartitionById(blocks, "block").select("block", F.explode(F.array_append("dsts", F.col("src"))).alias("src"))  # by block, so that repeats go before the shuffle
    asked = reached.unionByName(lists.select("block", "src")).distinct()
    rows = asked.join(lists.withColumnRenamed("block", "_home"), "src").select("block", "src", "h", "dsts", "weights", (F.col("block") == F.col("_home")).alias("own"))
    code = edges.schema["src"].dataType.simpleString()
    out = f"u {code}, v {code}, paths long, support double, penalty double"
    if not n:
        return rows.repartitionById(blocks, "block").drop("block").mapInArrow(three_hops, out)
    full = lists.where(F.size("dsts") == n).select("src", "block")  # only these can have observed links beyond their list
    known = salted_join(edges.select("src", "dst"), full, "src", "inner").select("block", "src", F.lit(None).cast("double").alias("h"), F.array("dst").alias("dsts"), F.lit(None).cast("array<double>").alias("weights"), F.lit(True).alias("own"))
    return rows.unionByName(known).repartitionById(blocks, "block").drop("block").mapInArrow(three_hops, out)


def path_features(claims: DataFrame, cutoff: int | None = None, max_len: int = 2, n: int = 120) -> DataFrame:
    """Support, number of mediators and hub penalty per missing link.  Three-hop paths add support and penalty but no mediators."""
    cols = ["path_support_raw", "mediator_count", "hub_penalty"]
    two = _links(claims, cutoff, n, True, False).select("u", "v", *cols)
    if max_len < 3:
        return two
    three = support_3(claims, cutoff, n).select("u", "v", F.col("support").alias("path_support_raw"), F.lit(0).cast("long").alias("mediator_count"), F.col("penalty").alias("hub_penalty"))
    return two.unionByName(three).groupBy("u", "v").agg(*[F.sum(c).alias(c) for c in cols])


def ranked_paths(claims: DataFrame, cutoff: int | None = None, n: int = 120, top_k: int = 10) -> DataFrame:
    """(u, w, v, support, penalty, rank) of the ``top_k`` mediators of each missing link; a bounded top-k per pair, cut before observed links are dropped."""
    edges = Scratch(claims.sparkSession, "links").write(edge_aggregate(claims, cutoff), "edges")
    rows = hop_rows(edges, n, True, False).select("u", "w", "v", F.round("path_support_raw", 6).alias("support"), F.col("hub_penalty").alias("penalty"))
    best = topn_per_key(rows, ["u", "v"], [F.desc("support"), F.asc("w")], top_k, "rank")
    return best.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"], "left_anti")


def motif_features(claims: DataFrame, cutoff: int | None = None, n: int = 120) -> DataFrame:
    """Closed-triad motifs per missing link: number and sum of sqrt(claims in x claims out)."""
    return _links(claims, cutoff, n, False, True).select("u", "v", "motif_count", "motif_bonus_raw")
