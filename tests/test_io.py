"""Sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import elt as B
from claimloom.sources import adapters as A
from claimloom.sources import sinks as K
from claimloom.streaming import streams as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_csv_directory_with_synonyms(spark, tmp_path):
    write(tmp_path / "edges.csv", "PaperID,Year,Cause,Effect,causal,w\nW1,2001,A,B,yes,2\nW1,x,A,B,no,\nW2,2003,,B,1,1\n")
    b = A.CsvDirectory(str(tmp_path)).load(spark)
    e = b.edges.orderBy("weight").collect()
    assert [(r["year"], r["is_causal"], r["weight"], r["relation_type"]) for r in e] == [(0, False, 1.0, "unspecified"), (2001, True, 2.0, "unspecified")]
    assert {r["code"] for r in b.nodes.collect()} >= {"A", "B"}
    c = b.corpus()
    assert len(c.columns) == 15 and {r["src_label"] for r in c.collect()} == {"A"}
    with pytest.raises(ValueError):
        A.CsvDirectory(str(tmp_path / "none")).load(spark)
    with pytest.raises(ValueError):
        A.SingleFile("x.txt").load(spark)


def test_jsonl_and_parquet_discovery(spark, tmp_path):
    write(tmp_path / "e.jsonl", '{"src": "A", "dst": "B", "src_label": "a1"}\n\n{"src": "A", "dst": "C", "src_label": "a1"}\n')
    b = A.SingleFile(str(tmp_path / "e.jsonl")).load(spark)
    assert b.edges.count() == 2 and {r["label"] for r in b.nodes.collect()} == {"a1", "B", "C"}
    b.edges.write.parquet(str(tmp_path / "claims"))
    b.nodes.write.parquet(str(tmp_path / "nodes"))
    d = A.ParquetDiscovery([str(tmp_path / "claims"), str(tmp_path / "nodes")]).load(spark)
    assert d.edges.count() == 2 and d.nodes.count() == 3


def test_payload(spark):
    p = '{"nodes": [{"node_id": "n1", "label": "x", "surface_forms": ["x"]}, {"node_id": "n1", "label": "y"}, {"label": "z"}], "edges": [{"edge_id": "e1", "source_node_id": "n1", "target_node_id": "n2", "uses_data": true}]}'
    n, e = A.flatten_payload(spark.createDataFrame([("c1", p), ("c2", "{broken"), ("c3", None)], "custom_id string, payload string"))
    assert [(r["node_id"], r["label"], r["surface_forms_json"]) for r in n.collect()] == [("n1", "x", '["x"]')]
    assert e.first()["uses_data"] is True


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 5}", 2000 + i % 3) for i in range(30)], "id int, k string, year int")
    index = K.write_shards(df, "k", str(tmp_path / "shards"), 2)
    assert index.count() == 5 and spark.read.json(str(tmp_path / "shards")).count() == 30
    assert K.write_buckets(df, "year", str(tmp_path / "buckets"), ["id"]).count() == 3
    assert K.digest(df) == K.digest(df.orderBy(F.rand(3))) != K.digest(df.limit(29))
    assert K.append_new(spark, df, str(tmp_path / "log"), ["id"]) == 30 and K.append_new(spark, df, str(tmp_path / "log"), ["id"]) == 0
    more = spark.createDataFrame([(100, "b", 2000), (100, "a", 2001), (None, "x", 2000), (None, "x", 2000)], df.schema)
    assert K.append_new(spark, more, str(tmp_path / "log"), ["id"]) == 2 and K.append_new(spark, more, str(tmp_path / "log"), ["id"]) == 0
    corpus = df.select(F.col("k").alias("src_code"), F.col("k").alias("dst_code"), "year")
    log = K.write_bundle(corpus, {"papers": df}, str(tmp_path / "bundle"))
    assert {r["name"]: r["rows"] for r in log.collect()} == {"corpus": 30, "papers": 30}
    K.write_jsonl(more, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4


def test_first_delivered_and_combine(spark):
    a = spark.createDataFrame([("x", 1, None), ("x", 1, "b"), (None, 2, "c")], "k string, n int, s string")
    assert sorted(map(tuple, B.first_delivered(a, ["k"], ["n"]).collect()), key=str) == [("x", 1, None), (None, 2, "c")]
    got = {r["k"]: r["n"] for r in B.combine_first_wins([a.where("n = 1"), a.withColumn("n", F.lit(9))], "k").collect()}
    assert got == {"x": 1, None: 9}


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, 1_700_000_000 + 3600 * i, i % 2, "ab"[i % 2], 1.0) for i in range(48)], "event_id long, s long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    src = str(tmp_path / "in")
    e.repartition(3).write.parquet(src)
    out = str(tmp_path / "out")
    q = S.merge_batches(S.first_seen(S.read_stream(spark, src, e.schema), ["event_id"], "10 days"), lambda df, i: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 48
    batch = S.tumbling_counts(e).agg(F.sum("n")).first()[0]
    assert batch == 48 and S.sessions(e, "90 minutes").count() == 48
