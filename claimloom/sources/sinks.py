"""Sinks: corpus, stores, sharded and bucketed exports, locked artefacts, resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def write_corpus(corpus: DataFrame, path: str) -> None:
    """The corpus partitioned by year (readers prune by cutoff), clustered so that every year has few files; a year that holds very many rows is split over tasks."""
    corpus.hint("rebalance", "year").sortWithinPartitions("src_code", "dst_code").write.mode("overwrite").partitionBy("year").parquet(path)


def write_bundle(corpus: DataFrame, sidecars: dict[str, DataFrame], path: str) -> DataFrame:
    """The corpus, its sidecar tables (papers, nodes, ...) and a log of the rows of each; returns the log."""
    write_corpus(corpus, f"{path}/corpus")
    write_store(sidecars, path)
    counts = None
    for name in ("corpus", *sidecars):
        n = corpus.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        counts = n if counts is None else counts.unionByName(n)
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/ingest_log")
    return corpus.sparkSession.read.schema("name string, rows long").json(f"{path}/ingest_log")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, one record a line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_store(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_shards(df: DataFrame, key: str, path: str, per_shard: int = 256) -> DataFrame:
    """JSON shards of about ``per_shard`` keys each, and the key -> shard index; shards come from a hash, so no global sort is needed."""
    n = df.select(key).distinct().count()
    shard = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // per_shard)))).cast("int")
    rows = df.withColumn("shard", shard)
    rows.repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)
    return rows.select(key, "shard").distinct()


def write_buckets(df: DataFrame, bucket: str, path: str, order: list[str] | None = None) -> DataFrame:
    """One folder of gzip JSON lines per bucket, sorted inside, and a manifest of counts."""
    out = df.hint("rebalance", bucket)
    if order:
        out = out.sortWithinPartitions(bucket, *order)
    out.write.mode("overwrite").partitionBy(bucket).option("compression", "gzip").json(path)
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"))


def digest(df: DataFrame) -> str:
    """A content digest that does not depend on the order of rows: the sum of row hashes, itself hashed."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s")).select(F.sha2(F.concat_ws("|", "n", "s"), 256)).first()
    return r[0]


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> int:
    """Append only rows whose key is not stored yet, one row per key (the smallest); returns how many (resumable runs).

    The new rows are computed once, into a table of their own, and counted there.  A null key is a key like any other.
    """
    from pyspark.errors import AnalysisException

    rest = [c for c in df.columns if c not in keys]
    new = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else df.distinct()
    try:
        done = spark.read.parquet(path).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        new = new.join(done, same, "left_anti")
    new = Scratch(spark, "append").write(new.select(*df.columns), "new")
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n
