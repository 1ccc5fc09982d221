"""Plan shapes that keep working when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 256
#: Rows below which a join of any skew fits one task anyway.
HOT_FLOOR = 20_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, floor: int = HOT_FLOOR, count: str | None = None) -> list:
    """Keys of ``df`` that hold more than ``share`` of its rows: at most ``1 / share`` values, so safe to collect.

    One job over the key column: counts are combined map-side, only the largest ``1 / share`` come to the driver, the total is observed on the way.
    ``count`` names a column of counts where ``df`` is aggregated already.  Nulls are never hot (they match nothing in an equi-join).
    """
    n = F.sum(count) if count else F.count(F.lit(1))
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(n.alias("n"))
    seen = Observation()
    top = counts.observe(seen, F.sum("n").alias("t")).orderBy(F.desc("n")).limit(int(1 / share)).collect()
    total = seen.get["t"] if top else 0
    return [r["k"] for r in top if r["n"] > floor and r["n"] > total * share]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 32, hot: list | None = None) -> DataFrame:
    """Equi-join on ``key`` where ``left`` may be skewed and ``right`` has one row per key.

    Rows of hot keys get a salt from a hash of the whole left row; the matching right rows, at most ``1 / HOT_SHARE`` of
    them, are copied once per salt.  Without hot keys the plan is the plain join.  ``hot`` spares the count where the keys are known.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cols = [c for c in left.columns if c != key]
    salt = F.when(is_hot, F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    out = left.withColumn("_salt", salt).join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how)
    return out.drop("_salt")


def topn_per_key(df: DataFrame, keys: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key.  Spark pushes the limit below the shuffle (WindowGroupLimit), so a hot key sends
    at most ``n`` rows per map task.  ``order`` must end with unique columns."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)
