"""References to records that do not exist: incremental orphan tracking (problem 1).

Method.  Feeds arrive in batches.  The state is kept in a named folder that outlives the process, in ``buckets`` by a hash of the parent key: the *parent index*
(one row per batch and parent key: first seen, last seen, whether the last row was a deletion), the *status log by parent* (one row per reference
whenever its status changed; an orphan is a row with a reason) and the list of finished epochs.  A batch

1. appends its parents' per-key summary,
2. probes the parent index with its new references,
3. looks up the waiting and resolved references of just the parent keys that the batch touched, so that an arriving
   parent resolves waiting orphans and a deletion reopens resolved references,
4. appends only the statuses that changed, counts pending orphans as the epoch's snapshot, and commits the epoch.

Only buckets that the batch touches are read.  Logs are compacted on write: when a generation holds ``compact_every`` epochs, they are merged into one run with one row per key (and per
reference), so what a batch reads follows the live keys of its buckets, not the history.  An epoch is committed by writing its marker last; runs without marker, left by a
lost driver, are ignored and overwritten.  Batches may come in any order and split any way: the final state is the same.

Defined cases: a null reference is never an orphan; a null ``ref_at``/``at`` counts as later than any date; among rows
of equal time the smaller reference and the deletion win; repeated rows count once; empty inputs give no rows.  Extra columns of
the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, folder_names, remove
from ..plans.skew import hot_keys, salted_join

SEP = "\u0001"
NEVER = "9999-12-31 00:00:00"
REF_ID = ["ref_table", "ref_field", "custom_id", "item_id"]
PARENTS = "pkey string, first_at timestamp, last_at timestamp, last_gone boolean"
STATUS = "ref_table string, ref_field string, custom_id string, item_id string, pkey string, ref_at timestamp, reason string, epoch int"


def _when(c: str):
    return F.coalesce(F.col(c).cast("timestamp"), F.lit(NEVER).cast("timestamp"))


class OrphanTracker:
    """Keyed orphan state over batches of references and parents.

    references: ref_table, ref_field, custom_id, item_id, pkey (null: no reference), ref_at
    parents: pkey, at, gone

    ``state``: the folder of the state; a tracker on a folder that holds one resumes it.  Without it the state lives in a scratch folder, as long as the process.
    """

    def __init__(self, spark: SparkSession, state: str | None = None, buckets: int = 64, compact_every: int = 8):
        self.spark, self.buckets, self.compact_every = spark, buckets, compact_every
        self.scratch = None if state else Scratch(spark, "orphans")
        self.root = (state or self.scratch.root).rstrip("/")
        self.hot: set[str] = set()
        done = {int(n.removeprefix("epoch-")) for n in folder_names(spark, f"{self.root}/committed")}
        self.epoch = max(done, default=-1) + 1
        self.base = max((int(n.removeprefix("base-")) for n in folder_names(spark, f"{self.root}/bases")), default=-1)  # epochs up to it are in one run
        if done:
            kept = self.spark.read.json(f"{self.root}/committed/epoch-{self.epoch - 1}").first()
            self.buckets, self.hot = kept["buckets"], set(kept["hot"] or [])

    def _runs(self, log: str) -> list[str]:
        runs = [f"{self.root}/{log}/run-{e}" for e in range(self.base + 1, self.epoch)]
        return [f"{self.root}/{log}/base-{self.base}", *runs] if self.base >= 0 else runs

    def _read(self, log: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        paths = self._runs(log)
        if not paths:
            return self._empty(ddl)
        df = reduce(DataFrame.unionByName, [self.spark.read.schema(f"{ddl}, bucket int").parquet(p) for p in paths])
        return (df.where(F.col("bucket").isin(buckets)) if buckets is not None else df).drop("bucket")

    def _write(self, df: DataFrame, path: str) -> None:
        placed = df.withColumn("bucket", _bucket(self.buckets))
        placed.repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)

    def parent_index(self, buckets: list[int] | None = None) -> DataFrame:
        """One row per parent key ever seen: mergeable summaries of the batches' logs."""
        last = F.max(F.struct("last_at", "last_gone"))
        logs = self._read("parents", PARENTS, buckets)
        return logs.groupBy("pkey").agg(F.min("first_at").alias("first_at"), last.alias("l")).select("pkey", "first_at", F.col("l.last_at").alias("last_at"), F.col("l.last_gone").alias("last_gone"))

    def _latest(self, buckets: list[int] | None = None) -> DataFrame:
        """The latest status of every delivery (reference, parent key, time)."""
        log = self._read("status", STATUS, buckets)
        return log.groupBy(*REF_ID, "pkey", "ref_at").agg(F.max(F.struct("epoch", "reason")).alias("s")).select(*REF_ID, "pkey", "ref_at", F.col("s.reason").alias("reason"), F.col("s.epoch").alias("epoch"))

    def apply(self, references: DataFrame, parents: DataFrame, snapshot: bool = True) -> None:
        """Take in one batch and commit it."""
        e = self.epoch
        last = F.max(F.struct(_when("at").alias("last_at"), F.coalesce("gone", F.lit(False)).alias("last_gone")))
        delta = parents.where("pkey is not null").groupBy("pkey").agg(F.min(_when("at")).alias("first_at"), last.alias("l"))
        self._write(delta.select("pkey", "first_at", F.col("l.last_at").alias("last_at"), F.col("l.last_gone").alias("last_gone")), f"{self.root}/parents/run-{e}")
        delta = self.spark.read.schema(f"{PARENTS}, bucket int").parquet(f"{self.root}/parents/run-{e}")
        first = F.min(F.struct(_when("ref_at").alias("ref_at"), F.col("pkey")))
        new = references.groupBy(*REF_ID).agg(first.alias("f")).select(*REF_ID, F.col("f.pkey").alias("pkey"), F.col("f.ref_at").alias("ref_at"), F.lit(None).cast("string").alias("was"), F.lit(True).alias("fresh"))
        self.hot |= set(hot_keys(references, "pkey"))  # a key that was hot once stays salted
        touched = new
        if self._runs("status"):  # references that wait for, or were resolved by, a parent this batch speaks of
            own = [r["bucket"] for r in delta.select("bucket").distinct().collect()]
            known = self._latest(own).join(delta.select("pkey"), "pkey", "left_semi")
            touched = new.unionByName(known.select(*REF_ID, "pkey", "ref_at", F.col("reason").alias("was"), F.lit(False).alias("fresh")))
            own = None if len(own) == self.buckets else sorted({*own, *(r["b"] for r in references.select(_bucket(self.buckets).alias("b")).distinct().collect())})
        else:
            own = None
        self.epoch = e + 1  # the index below includes this batch's parents
        judged = salted_join(touched, self.parent_index(own), "pkey", "left", hot=sorted(self.hot))
        reason = (
            F.when(F.col("pkey").isNull(), F.lit(None))
            .when(F.col("first_at").isNull(), "missing")
            .when(F.col("last_gone"), "deleted")
            .when(F.col("first_at") > F.col("ref_at"), "late")
        )
        out = judged.withColumn("reason", reason.cast("string")).where("fresh or not (was <=> reason)")
        self._write(out.select(*REF_ID, "pkey", "ref_at", "reason", F.lit(e).alias("epoch")), f"{self.root}/status/run-{e}")
        if snapshot:
            self.snapshot().withColumn("epoch", F.lit(e)).write.mode("overwrite").parquet(f"{self.root}/snapshots/epoch={e}")
        mark = self.spark.createDataFrame([(e, self.buckets, sorted(self.hot))], "epoch int, buckets int, hot array<string>")
        mark.coalesce(1).write.mode("overwrite").json(f"{self.root}/committed/epoch-{e}")
        if e - self.base >= self.compact_every:
            self._compact()

    def _compact(self) -> None:
        """Merge all runs into one per log: one row per parent key, one per delivery of a reference."""
        e, old, base = self.epoch - 1, [p for log in ("parents", "status") for p in self._runs(log)], self.base
        self._write(self.parent_index(), f"{self.root}/parents/base-{e}")
        self._write(self._latest().select(*REF_ID, "pkey", "ref_at", "reason", "epoch"), f"{self.root}/status/base-{e}")
        self.spark.createDataFrame([(e,)], "epoch int").coalesce(1).write.mode("overwrite").json(f"{self.root}/bases/base-{e}")
        self.base = e
        for p in old + ([f"{self.root}/bases/base-{base}"] if base >= 0 else []):
            remove(self.spark, p)

    def references(self) -> DataFrame:
        """Every reference with its current reason (null: resolved); a redelivered record counts by its earliest row."""
        best = F.min(F.struct("ref_at", "pkey", (-F.col("epoch")).alias("age"), "reason"))
        return self._read("status", STATUS).groupBy(*REF_ID).agg(best.alias("b")).select(*REF_ID, F.col("b.pkey").alias("pkey"), F.col("b.ref_at").alias("ref_at"), F.col("b.reason").alias("reason"))

    def orphans(self) -> DataFrame:
        return self.references().where("reason is not null")

    def snapshot(self, period: str = "month") -> DataFrame:
        """Pending orphans per table, field, ingestion period and reason (null period: no date)."""
        at = F.when(F.col("ref_at") < F.lit(NEVER).cast("timestamp"), F.date_trunc(period, "ref_at"))
        return self.orphans().groupBy("ref_table", "ref_field", at.alias("period"), "reason").agg(F.count(F.lit(1)).alias("orphans"))

    def snapshots(self) -> DataFrame:
        """The snapshot of every epoch that took one."""
        ddl = "ref_table string, ref_field string, period timestamp, reason string, orphans long, epoch int"
        return self.spark.read.schema(ddl).parquet(f"{self.root}/snapshots") if folder_names(self.spark, f"{self.root}/snapshots") else self._empty(ddl)

    def _empty(self, ddl: str) -> DataFrame:
        return self.spark.createDataFrame([], ddl)


def _bucket(n: int):
    return F.pmod(F.xxhash64(F.coalesce("pkey", F.lit(""))), F.lit(n)).cast("int")


def claim_references(edges: DataFrame, soft: DataFrame) -> DataFrame:
    """The references of claims to paper-local nodes and of mappings to concepts, in the tracker's form."""
    node_key = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("n"), F.coalesce("custom_id", F.lit(SEP)), F.lit(SEP), F.col(c)))
    fields = [F.struct(F.lit(f).alias("ref_field"), node_key(f).alias("pkey")) for f in ("source_node_id", "target_node_id")]
    of_edges = edges.select("custom_id", F.col("edge_id").alias("item_id"), F.col("ingested_at").alias("ref_at"), F.inline(F.array(*fields)))
    of_soft = soft.select("custom_id", F.col("node_id").alias("item_id"), F.col("ingested_at").alias("ref_at"), F.lit("concept_id").alias("ref_field"), F.concat(F.lit("c"), "concept_id").alias("pkey"))
    return of_edges.withColumn("ref_table", F.lit("edges")).unionByName(of_soft.withColumn("ref_table", F.lit("instance_mappings_soft")))


def claim_parents(nodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """Arrivals and deletions of nodes and concepts, in the tracker's form."""
    of_nodes = nodes.where("node_id is not null").select(F.concat(F.lit("n"), F.coalesce("custom_id", F.lit(SEP)), F.lit(SEP), F.col("node_id")).alias("pkey"), F.col("ingested_at").alias("at"), F.col("is_deleted").alias("gone"))
    of_concepts = concepts.where("concept_id is not null").select(F.concat(F.lit("c"), "concept_id").alias("pkey"), F.col("ingested_at").alias("at"), (F.col("head_status") == "retired").alias("gone"))
    return of_nodes.unionByName(of_concepts)


def track_claims(spark: SparkSession, edges: DataFrame, soft: DataFrame, nodes: DataFrame, concepts: DataFrame, epochs: int = 3, state: str | None = None) -> OrphanTracker:
    """Replay the tables through the tracker in ``epochs`` slices of equal ingestion time."""
    refs, parents = claim_references(edges, soft), claim_parents(nodes, concepts)
    ranges = [t.agg(F.min(c).alias("lo"), F.max(c).alias("hi")) for t, c in ((edges, "ingested_at"), (soft, "ingested_at"), (nodes, "ingested_at"))]
    lo, hi = reduce(DataFrame.unionByName, ranges).agg(F.min(F.unix_micros("lo")), F.max(F.unix_micros("hi"))).first()
    tracker = OrphanTracker(spark, state, buckets=16)
    if lo is None or epochs <= 1:
        tracker.apply(refs, parents, snapshot=False)
        return tracker
    cuts = [lo + (hi - lo) * i // epochs for i in range(1, epochs)]
    for i in range(epochs):
        def part(df, c):
            t = F.unix_micros(F.col(c).cast("timestamp"))
            above = t >= F.lit(cuts[i - 1]) if i else F.lit(True)
            below = t < F.lit(cuts[i]) if i < epochs - 1 else F.lit(True)
            keep = above & below
            return df.where(keep | (F.col(c).isNull() if i == epochs - 1 else F.lit(False)))
        tracker.apply(part(refs, "ref_at"), part(parents, "at"), snapshot=False)
    return tracker
