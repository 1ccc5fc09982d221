"""Orphan tracking against a direct evaluation, for any split into batches."""

import random
from datetime import datetime, timedelta

from claimloom.operators.orphans import OrphanTracker, claim_parents, claim_references, track_claims

T0 = datetime(2025, 1, 1)
REFS = "ref_table string, ref_field string, custom_id string, item_id string, pkey string, ref_at timestamp"
PARENTS = "pkey string, at timestamp, gone boolean"


def expected(refs, parents):
    first, last, born = {}, {}, {}
    for t, f, c, i, k, at in refs:
        key, val = (t, f, c, i), (at or datetime.max, k is not None, k or "")
        if key not in first or val < first[key]:
            first[key] = val
    for k, at, gone in parents:
        if k is None:
            continue
        at = at or datetime.max
        born[k] = min(born.get(k, at), at)
        last[k] = max(last.get(k, (at, gone)), (at, gone))
    out = {}
    for key, (at, has, k) in first.items():
        if not has:
            continue
        if k not in born:
            out[key] = "missing"
        elif last[k][1]:
            out[key] = "deleted"
        elif born[k] > at:
            out[key] = "late"
    return out


def run(spark, refs, parents, cuts):
    tracker = OrphanTracker(spark)
    for part in range(max(cuts.values(), default=0) + 1):
        r = [x for n, x in enumerate(refs) if cuts.get(("r", n), 0) == part]
        p = [x for n, x in enumerate(parents) if cuts.get(("p", n), 0) == part]
        tracker.apply(spark.createDataFrame(r, REFS), spark.createDataFrame(p, PARENTS))
    return {tuple(x[:4]): x["reason"] for x in tracker.orphans().select("ref_table", "ref_field", "custom_id", "item_id", "reason").collect()}


def test_any_split_of_batches_gives_the_same_state(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(12)]
    when = lambda: T0 + timedelta(days=rng.randint(0, 20)) if rng.random() > 0.1 else None
    refs = [("t", "f", f"c{rng.randint(0, 3)}", f"i{rng.randint(0, 12)}", rng.choice([*keys, "none", None]), when()) for _ in range(80)]
    parents = [(rng.choice([*keys[:9], None]), when(), rng.random() < 0.3) for _ in range(40)]
    want = expected(refs, parents)
    assert want and set(want.values()) == {"missing", "deleted", "late"}
    for parts in (1, 3):
        cuts = {("r", n): rng.randrange(parts) for n in range(len(refs))} | {("p", n): rng.randrange(parts) for n in range(len(parents))}
        assert run(spark, refs, parents, cuts) == want


def test_deletion_reopens_and_restoring_resolves(spark):
    t = OrphanTracker(spark)
    day = lambda n: T0 + timedelta(days=n)
    none_p, none_r = spark.createDataFrame([], PARENTS), spark.createDataFrame([], REFS)
    state = lambda: [r["reason"] for r in t.orphans().collect()]
    t.apply(spark.createDataFrame([("t", "f", "c", "i", "k", day(5))], REFS), none_p)
    assert state() == ["missing"]
    t.apply(none_r, spark.createDataFrame([("k", day(1), False)], PARENTS))
    assert state() == []
    t.apply(none_r, spark.createDataFrame([("k", day(7), True)], PARENTS))
    assert state() == ["deleted"]
    t.apply(none_r, spark.createDataFrame([("k", day(9), False)], PARENTS))
    assert state() == []
    assert t.snapshot().count() == 0


def test_empty_and_extra_columns(spark):
    e = "custom_id string, edge_id string, source_node_id string, target_node_id string, ingested_at timestamp, pkey string, reason string"
    s = "custom_id string, node_id string, concept_id string, ingested_at timestamp, epoch int"
    n = "custom_id string, node_id string, is_deleted boolean, ingested_at timestamp, gone int"
    h = "concept_id string, head_status string, ingested_at timestamp, at string"
    empty = [spark.createDataFrame([], x) for x in (e, s, n, h)]
    assert track_claims(spark, *empty).orphans().count() == 0
    edges = spark.createDataFrame([("c", "e", "n1", None, T0, "x", "y"), (None, None, "n1", "n2", None, None, None)], e)
    soft = spark.createDataFrame([("c", "n1", "H1", T0, 1), ("c", "n1", "H1", T0, 1)], s)
    nodes = spark.createDataFrame([("c", "n1", None, T0, 3), ("c", None, False, T0, 3)], n)
    heads = spark.createDataFrame([("H1", None, T0 + timedelta(1), "x"), (None, "retired", T0, "x")], h)
    got = sorted(tuple(r) for r in track_claims(spark, edges, soft, nodes, heads).orphans().select("ref_table", "ref_field", "item_id", "reason").collect() if r["item_id"])
    assert got == [("instance_mappings_soft", "concept_id", "n1", "late")]
    assert claim_references(edges, soft).count() == 6 and claim_parents(nodes, heads).count() == 2


def test_hot_parent(spark):
    refs = spark.range(60_000).selectExpr("'t' ref_table", "'f' ref_field", "cast(id as string) custom_id", "'i' item_id", "if(id % 3 = 0, 'hot', concat('k', id % 1000)) pkey", "timestamp'2025-01-01' ref_at")
    t = OrphanTracker(spark)
    t.apply(refs, spark.createDataFrame([("hot", T0, True)], PARENTS))
    got = {r["reason"]: r["count"] for r in t.orphans().groupBy("reason").count().collect()}
    assert got == {"deleted": 20_000, "missing": 40_000}


def test_state_outlives_the_tracker_and_is_compacted(spark, tmp_path):
    rng = random.Random(5)
    keys = [f"k{i}" for i in range(30)]
    refs, parents, state = [], [], str(tmp_path / "state")
    for e in range(7):
        r = [("t", "f", f"c{rng.randint(0, 9)}", f"i{e}-{rng.randint(0, 9)}", rng.choice([*keys, None]), T0 + timedelta(days=rng.randint(0, 20))) for _ in range(15)]
        p = [(rng.choice(keys), T0 + timedelta(days=rng.randint(0, 20)), rng.random() < 0.3) for _ in range(6)]
        refs, parents = refs + r, parents + p
        t = OrphanTracker(spark, state, buckets=4, compact_every=3)  # a new tracker each time, as another process would make
        assert t.epoch == e
        t.apply(spark.createDataFrame(r, REFS), spark.createDataFrame(p, PARENTS))
        got = {tuple(x[:4]): x["reason"] for x in OrphanTracker(spark, state).orphans().select("ref_table", "ref_field", "custom_id", "item_id", "reason").collect()}
        assert got == expected(refs, parents)
    t = OrphanTracker(spark, state)
    assert t.buckets == 4 and t.base == 5 and len(t._runs("status")) == 2 and t.parent_index().count() == len({p[0] for p in parents})
    assert sum(r["orphans"] for r in t.snapshots().where("epoch = 6").collect()) == len(expected(refs, parents)) and t.snapshots().select("epoch").distinct().count() == 7


def test_an_epoch_without_its_mark_is_ignored(spark, tmp_path):
    state = str(tmp_path / "state")
    ref = lambda i: spark.createDataFrame([("t", "f", "c", i, "k", T0)], REFS)
    none = spark.createDataFrame([], PARENTS)
    OrphanTracker(spark, state).apply(ref("a"), none)
    OrphanTracker(spark, state).apply(ref("b"), none)
    import shutil

    shutil.rmtree(f"{state}/committed/epoch-1")  # the driver was lost before it committed
    t = OrphanTracker(spark, state)
    assert t.epoch == 1 and [r["item_id"] for r in t.orphans().collect()] == ["a"]
    t.apply(ref("c"), spark.createDataFrame([("k", T0, False)], PARENTS))
    assert OrphanTracker(spark, state).orphans().count() == 0 and OrphanTracker(spark, state).references().count() == 2
