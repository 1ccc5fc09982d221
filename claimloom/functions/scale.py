"""Normalisations over whole tables or per key.

A global minimum and maximum is one aggregate row broadcast back (its size is one row by construction), never a window without keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _scaled(x: Column, lo: Column, hi: Column, flat: Column, constant_one: Column) -> Column:
    return F.when(flat, F.when(constant_one, 1.0).otherwise(0.0)).otherwise((x - lo) / (hi - lo))


def min_max(df: DataFrame, cols: dict[str, str], by: list[str] | None = None, fill_zero: bool = False, rtol: float = 1e-5, atol: float = 1e-8, few: bool = False) -> DataFrame:
    """Add ``cols[name]`` = ``name`` scaled to 0..1 over the table, or within ``by`` (``few``: of few values, so ranges are broadcast).

    A constant column (within the tolerances) becomes 1 if its maximum is above 0, else 0.  ``fill_zero`` counts nulls as 0 first; otherwise
    they stay null and are left out of the range.
    """
    src = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if fill_zero else F.col(c).cast("double") for c in cols}
    stats = [f(src[c]).alias(f"_{i}_{n}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    if by:
        ranges = df.groupBy(*by).agg(*stats)
        out = df.join(F.broadcast(ranges) if few else ranges, by)
    else:
        out = df.crossJoin(F.broadcast(df.agg(*stats)))
    for i, (c, name) in enumerate(cols.items()):
        lo, hi = F.col(f"_{i}_lo"), F.col(f"_{i}_hi")
        flat = F.abs(lo - hi) <= atol + rtol * F.abs(hi)
        out = out.withColumn(name, _scaled(src[c], lo, hi, flat, hi > 0))
    return out.drop(*[f"_{i}_{n}" for i in range(len(cols)) for n in ("lo", "hi")])


def z_score(df: DataFrame, cols: dict[str, str], by: list[str] | None = None, floor: float = 1e-12) -> DataFrame:
    """Add population z-scores, over the table or within ``by``; 0 where the deviation is at most ``floor``."""
    stats = [f(F.col(c).cast("double")).alias(f"_{i}_{n}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    out = df.join(df.groupBy(*by).agg(*stats), by) if by else df.crossJoin(F.broadcast(df.agg(*stats)))
    for i, (c, name) in enumerate(cols.items()):
        s = F.col(f"_{i}_s")
        out = out.withColumn(name, F.when(F.coalesce(s, F.lit(0.0)) <= floor, 0.0).otherwise((F.col(c) - F.col(f"_{i}_m")) / s))
    return out.drop(*[f"_{i}_{n}" for i in range(len(cols)) for n in ("m", "s")])


def recency_weight(last_year: int, decay: float = 0.0, stability_coef: float = 0.0, causal_bonus: float = 0.0) -> Column:
    """Claim weight with exponential decay of age, stability and causal terms."""
    age = F.greatest(F.lit(0), F.lit(last_year) - F.col("year"))
    steady = F.least(F.greatest(F.coalesce("stability", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.col("weight") * F.exp(-decay * age) * (1 + stability_coef * steady) * (1 + causal_bonus * F.col("is_causal").cast("double"))


def decile(rank: Column, n: Column, q: int = 10) -> Column:
    """Quantile bucket of a 1-based unique rank among n rows (as cutting at linear quantiles does, not ntile)."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * q / F.greatest(n - 1, F.lit(1)))).cast("int")


def running_share(df: DataFrame, value: str, order: list, by: list[str], name: str) -> DataFrame:
    """Cumulative share of ``value`` within ``by`` in the given order."""
    w = Window.partitionBy(*by)
    run = F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, run / F.sum(value).over(w))
