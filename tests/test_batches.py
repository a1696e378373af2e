import pytest
from pyspark.sql import functions as F

from textloom.functions import json
from textloom.operators import batches, citations, evidence
from textloom.plans import ingestion


def state(df):
    return {r.shard: (r.status, r.attempts) for r in df.collect()}


def test_lifecycle(spark):
    requests = spark.createDataFrame([(1, "a", 50), (1, "b", 10), (2, "a", 80), (3, "c", 30)], "shard int, entity_id string, token_count int")
    s = batches.prepared(requests)
    assert {(r.shard, r.n_entities, r.tokens) for r in s.collect()} == {(1, 2, 60), (2, 1, 80), (3, 1, 30)}
    s = batches.submitted(s, 100)
    assert state(s) == {1: ("submitted", 1), 2: ("prepared", 0), 3: ("submitted", 1)}
    reports = spark.createDataFrame([(1, "failed", 1), (1, "completed", 2), (3, "failed", 1), (2, "completed", 1)], "shard int, status string, reported_at int")
    s = batches.updated(s, reports)
    assert state(s) == {1: ("completed", 1), 2: ("prepared", 0), 3: ("failed", 1)}
    assert state(batches.updated(s, reports)) == state(s)
    assert state(batches.retried(s, 200)) == {1: ("completed", 1), 2: ("submitted", 1), 3: ("submitted", 2)}
    assert batches.unknown(spark.createDataFrame([(9,)], "shard int"), s).count() == 1


def test_points(spark):
    manifest = spark.createDataFrame([("c1", "p1", "e"), ("c2", "p2", "f")], "custom_id string, point_id string, entity_id string")
    got = batches.points(spark.createDataFrame([("c1", [1.0])], "custom_id string, vector array<double>"), manifest)
    assert got.first().payload.entity_id == "e" and batches.missing(manifest, got).count() == 1
    with pytest.raises(Exception, match="no manifest row"):
        batches.points(spark.createDataFrame([("zz", [1.0])], "custom_id string, vector array<double>"), manifest).collect()


def test_ingestion(spark):
    docs = spark.createDataFrame([("a", "T", "متن " * 2000), ("b", "T", None), ("c", None, None)], "document_id string, title string, text string")
    chunks, places, status = ingestion.ingest(docs, 64)
    got = {r.document_id: (r.ingestion_status, r.n_points) for r in status.collect()}
    assert got["a"][0] == "indexed" and got["a"][1] > 1 and got["b"] == ("indexed", 1) and got["c"] == ("failed", 0)
    assert places.count() > 0 and ingestion.replaced(chunks, chunks).count() == chunks.count()


def test_evidence_of_hits(spark):
    schema = "id string, score double, payload struct<entity_id: string, labels: array<string>, title: string, text: string, url: string, node_type: string>"
    data = [("1", 0.9, ("e", ["Law"], "", "t", None, "")), ("2", 0.8, ("", ["Law"], "x", "t", None, "")), ("3", 0.7, ("f", ["Tag"], "x", " ", None, ""))]
    rows = evidence.from_hits(spark.createDataFrame(data, schema)).collect()
    assert [(r.entity_id, r.title, r.source_type, r.authority) for r in rows] == [("e", "e", "Law", "primary")]


def test_small_ones(spark):
    s = spark.createDataFrame([("r", "e", "S1", 0.12345678)], "run_id string, entity_id string, source_id string, score double")
    assert evidence.tool_rows(s).first().score == 0.123457
    assert evidence.known(spark.createDataFrame([("r", "e"), ("r", "x"), ("q", "e")], "run_id string, entity_id string"), s).count() == 1
    e = evidence.summary(spark.createDataFrame([(1.0,), (3.0,), (None,)], "score double")).first()
    assert (e["mean"], e["median"], e.least, e.failures) == (2.0, 2.0, 1.0, 1)
    assert evidence.settings({"TOP_K": "3"})["top_k"] == 3
    with pytest.raises(ValueError):
        evidence.settings({"DEPTH": "0"})
    w = evidence.weighted(spark.createDataFrame([("a", 0.5, 0.5), ("b", 1.0, None)], "id string, x double, y double"), {"x": 0.6, "y": 0.4}, ["id"])
    assert [r.id for r in w.collect()] == ["b", "a"]
    c = evidence.context(spark.createDataFrame([("r", "a", 5, 0.9), ("r", "a", 5, 0.1), ("r", "b", 6, 0.5), ("r", "c", 1, 0.1)], "run string, k string, n int, s double"), "run", "k", "n", "s", 11)
    assert {r.k for r in c.collect()} == {"a", "b"}


def test_json(spark):
    df = spark.createDataFrame([('{"a": {"Page_Count": 3, "b": ["x", null, "yy"]}}',), ("{bad",), (None,)], "j string")
    got = [r.ls for r in df.select(json.leaves("j").alias("ls")).collect()]
    assert [(x.path, x.value) for x in got[0]] == [("$.a.Page_Count", "3"), ("$.a.b[0]", "x"), ("$.a.b[2]", "yy")] and got[1] == [] and got[2] == []
    assert [r[0] for r in df.select(json.pick(json.leaves("j"), ["b"])).collect()] == ["yy", None, None]
    assert df.select(json.pick(json.leaves("j"), ["pagecount"])).first()[0] == "3"


def test_hierarchical_chunks(spark):
    df = spark.createDataFrame([("d", "ماده ۱ - " + "متن " * 30 + "\nماده ۲ - کوتاه")], "id string, text string")
    got = citations.hierarchical_chunks(df, "id", "text", 50, 5).orderBy("article", "part_index").collect()
    assert {r.article for r in got} == {"article:d:ماده:1", "article:d:ماده:2"} and got[0].part_count > 1 and F is not None
