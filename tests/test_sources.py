"""Sinks, the vector table, the embedding cache, numeric grades."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import figures as G
from siltstone.plans.evaluation_tables import traces
from siltstone.sources import tables as S


def test_partitioned_sinks(spark, small, tmp_path):
    t = traces(spark, small)
    S.write_traces(t, str(tmp_path / "traces"))
    back = spark.read.parquet(str(tmp_path / "traces"))
    assert back.count() == t.count()
    plan = back.filter("model = 'm1' AND prompt = 'p2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan
    S.write_chunks(spark.createDataFrame([("a", 1), ("b", 2)], "strategy string, x int"), str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).filter("strategy = 'a'").count() == 1


def test_vector_table(spark, tmp_path):
    unit = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "item_id long, v array<float>")
    S.VectorTable(unit, 2).persist(str(tmp_path / "v"))
    store = S.VectorTable.load(spark, str(tmp_path / "v"), 2)
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, q array<float>")
    assert [r.item_id for r in store.search(q, 5).orderBy("rank").collect()] == [2, 3, 1]
    with pytest.raises(Exception, match="has not 2 cells"):
        store.add(spark.createDataFrame([(4, [1.0])], "item_id long, v array<float>")).search(q, 5).collect()


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, text string")
    cache = spark.createDataFrame([("a", [1.0])], "text string, v array<double>").select(F.sha2("text", 256).alias("text_sha"), "v")
    assert [r.text for r in S.missing_texts(texts, cache).collect()] == ["b"]
    assert {r.id: r.v for r in S.cached_vectors(texts, cache, "id").collect()} == {1: [1.0], 2: None, 3: None}


def test_request_key_ignores_parameter_order(spark):
    rows = spark.range(1).select(
        S.request_key(F.lit("s"), F.lit("u"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("x"),
        S.request_key(F.lit("s"), F.lit("u"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("y"),
    ).first()
    assert rows.x == rows.y


@pytest.mark.parametrize("answer, label", [("$1.5 billion", "correct"), ("1,500", "correct"), ("1,500,000", "unit_error"), ("$1,600 million", "incorrect"), ("none", None)])
def test_numeric_grades(answer, label):
    g = G.grade_numeric(answer, G.Gold(1500.0, 1e6, "currency", 2))
    assert g["label"] == label
    if answer == "$1,600 million":
        assert g["sensitivity"][0.1] == "correct"


def test_zero_gold_has_no_unit_error():
    assert G.grade_numeric("$0.3 million", G.Gold(0.0, 1e6, "currency", 2))["label"] == "incorrect"
    assert G.verdict_schema(["C1"])["items"]["additionalProperties"] is False
