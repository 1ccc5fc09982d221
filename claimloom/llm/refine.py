"""Records that differ only in formatting, by progressive partition refinement (problem 6).

Method.  All labels of a scope start in one class.  Cheap invariants that no formatting can change split the classes first: the number of
letters and digits, then a histogram of the letters (the sorted letters, hashed).  Only rows of classes with several members
go on; they get the exact key, the sorted words, and the classes that remain with several members are the groups of copies.
Each step counts classes with map-side combining and joins the surviving class keys back, salted where one class is hot, so
no class is ever gathered in one task.

Two labels are the same if their words agree, with repetition, apart from case, order and everything that is no letter, digit or
mark.  Null labels and labels without any word are left out; repeated rows of one member count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch
from ..plans.skew import hot_keys, salted_join

SEPARATORS = r"[^\p{L}\p{N}\p{M}]+"


def folded(c):
    """Case-folded text; the letters whose lower case depends on the spelling or place are brought to one form."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def _several(scratch: Scratch, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose class on ``key`` has at least two distinct members; the classes' counts also tell which are hot."""
    counted = rows.groupBy(key).agg(F.min("member_key").alias("lo"), F.max("member_key").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    classes = scratch.write(counted.select(key, "n"), f"classes-{name}")
    return salted_join(rows, classes.drop("n"), key, "inner", hot=hot_keys(classes, key, count="n"))


def formatting_copies(rows: DataFrame) -> DataFrame:
    """(scope, member_key, group_key, copies) for rows (scope, member_key, label) in groups of two or more."""
    text = rows.where("label is not null and member_key is not null").select("scope", "member_key", folded(F.col("label")).alias("label"))
    scratch = Scratch(rows.sparkSession, "refine")
    bare = F.regexp_replace("label", SEPARATORS, "")
    one = text.withColumn("bare", bare).where("bare <> ''").withColumn("c1", F.xxhash64("scope", F.length("bare")))
    two = _several(scratch, one, "c1", "length").withColumn("c2", F.xxhash64("scope", F.array_join(F.array_sort(F.split("bare", "")), ""))).drop("bare", "c1")
    words = F.array_sort(F.filter(F.split("label", SEPARATORS), lambda w: w != ""))
    three = _several(scratch, scratch.write(two, "same-length"), "c2", "letters").select("scope", "member_key", F.concat_ws("\u0001", F.coalesce("scope", F.lit("")), F.array_join(words, " ")).alias("key")).distinct()
    three = scratch.write(three, "same-letters")
    groups = scratch.write(three.groupBy("key").agg(F.min("member_key").alias("group_key"), F.count_distinct("member_key").alias("copies")).where("copies > 1"), "groups")
    return salted_join(three, groups, "key", "inner", hot=hot_keys(groups, "key", count="copies")).select("scope", "member_key", "group_key", "copies")
