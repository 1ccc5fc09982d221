"""The claim view that all graph operators share, over star-schema tables or a prepared corpus.

A claim is one row: paper_id, year, src, dst, weight, is_causal, stability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .order import running_before
from .skew import salted_join


def claims_of(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Consecutive lines of an order as claims.  One window per order replaces a self-join; only needed columns are read."""
    code = F.concat(F.substring("p_type", 1, 1), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    p = part.select(F.col("p_partkey").alias("l_partkey"), code.alias("code"))
    lines = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = lines.join(o, "l_orderkey").join(p, "l_partkey").withColumn("dst", F.lead("code").over(w))
    return out.where("dst is not null and code <> dst").select(
        F.col("l_orderkey").alias("paper_id"), "year", F.col("code").alias("src"), "dst", (F.col("l_quantity") / 10).alias("weight"), (F.col("l_returnflag") == "R").alias("is_causal"), (1 - 5 * F.col("l_discount")).alias("stability")
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    return claims_of(table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part"))


def papers(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    title = F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").alias("year"), title.alias("title"), F.col("o_orderstatus").alias("venue"), F.coalesce("c_mktsegment", F.lit("")).alias("source"))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    code = F.concat(F.substring("p_type", 1, 1), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    return p.select(code.alias("code"), F.format_string("%s %s (%s)", "p_name", "p_type", "p_brand").alias("label"))


def numbered(claims: DataFrame) -> DataFrame:
    """Claims whose src and dst are numbers from 0, in the order of the codes: for operators that shuffle many pairs of concepts and return none of them."""
    ids = running_before(claims.select(F.explode(F.array("src", "dst")).alias("code")).distinct(), [F.asc("code")], F.lit(1), "id")
    for end in ("src", "dst"):
        claims = salted_join(claims, ids.select(F.col("code").alias(end), F.col("id").alias(f"_{end}")), end, "inner").drop(end).withColumnRenamed(f"_{end}", end)
    return claims


def until(df: DataFrame, cutoff: int | None) -> DataFrame:
    """Claims up to a year (pushed to the scan where the corpus is partitioned by year)."""
    return df if cutoff is None else df.where(F.col("year") <= cutoff)


def with_evidence(df: DataFrame, causal_only: bool = False, min_stability: float | None = None) -> DataFrame:
    """Evidence filters: causal claims only, and a floor of stability (a null stability is below every floor)."""
    if causal_only:
        df = df.where("is_causal")
    if min_stability is not None:
        df = df.where(F.coalesce("stability", F.lit(float("-inf"))) >= min_stability)
    return df
