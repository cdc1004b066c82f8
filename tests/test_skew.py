"""Paths meant for large or skewed tables, forced on small ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from autoprep.functions import lookup as lk
from autoprep.functions.indexing import number_rows
from autoprep.functions.quantiles import exact_quantiles
from autoprep.operators.split import assign_folds, stratified_split


def test_lookup_shuffles_hot_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(lk, "HOT_KEYS", 2)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 50).alias("k"))
    table = df.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.first("k") * 2).alias("v"))
    got = {r["id"]: (r["k"], r["v"]) for r in lk.lookup(df, ["k"], table, ["v"], weight="n", small_rows=0).collect()}
    assert len(got) == 3000
    assert all(v == (None if k is None else 2 * k) for k, v in got.values())
    plain = {r["id"]: r["v"] for r in lk.lookup(df, ["k"], table, ["v"], small_rows=0).collect()}
    assert plain == {i: v for i, (_, v) in got.items()}


@pytest.mark.parametrize("key", ["case when id % 3 < 2 then 7 else id % 997 end", "case when id % 3 < 2 then null else id % 997 end"])
def test_lookup_deals_hot_and_missing_keys_evenly(spark, monkeypatch, capsys, key):
    monkeypatch.setattr(lk, "HOT_KEYS", 5)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(40_000).selectExpr("id", f"{key} as k")
        table = df.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.first("k") * 2).alias("v"))
        out = lk.lookup(df, ["k"], table, ["v"], weight="n", small_rows=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        out.explain()
        plan = capsys.readouterr().out
        assert max(sizes) <= 2 * 40_000 / 4 and len(sizes) == 4
        assert any("hashpartitioning(__salted" in line for line in plan.splitlines())
        assert out.where("k is not null and (v is null or v <> 2 * k)").count() == 0
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_lookup_plan_follows_the_size(spark, capsys):
    df, table = spark.range(100).withColumnRenamed("id", "k"), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    lk.lookup(df, ["k"], table, ["v"]).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out


def test_long_keys_are_never_copied_to_the_driver(spark):
    table = spark.createDataFrame([("x" * 300, 1), ("a", 2)], "k string, v int")
    assert lk.small_copy(table, ["k"]) is None
    df = spark.createDataFrame([("x" * 300,), ("a",), ("b",)], "k string")
    assert sorted((r["v"] or 0) for r in lk.lookup(df, ["k"], table, ["v"]).collect()) == [0, 1, 2]


@pytest.mark.parametrize("shape", ["smooth", "hot", "two", "constant"])
def test_exact_quantiles_by_narrowing(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_000)
    if shape == "hot":
        x[:7000] = 0.0
    if shape == "two":
        x = np.where(x > 0.1, 1.0, 2.0)
    if shape == "constant":
        x[:] = 4.0
    df = spark.createDataFrame([(float(v),) for v in x], "x double").union(spark.createDataFrame([(None,)], "x double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    assert exact_quantiles(df, ["x"], probs, small_rows=50)["x"] == pytest.approx(np.quantile(x, probs).tolist(), abs=1e-12)


def test_numbering_is_global(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h")).repartition(7)
    rows = number_rows(df, ["h"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(500)) and [r["h"] for r in rows] == sorted(r["h"] for r in rows)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_splits_do_not_depend_on_partitions(spark, data, parts):
    df = spark.read.parquet(f"{data}/labels.parquet")
    base = assign_folds(stratified_split(df, "doc_id", "toxic"), "doc_id", "toxic")
    moved = assign_folds(stratified_split(df.repartition(parts), "doc_id", "toxic"), "doc_id", "toxic")
    assert base.exceptAll(moved).isEmpty()
    sizes = {(r["toxic"], r["split"]): r["count"] for r in base.groupBy("toxic", "split").count().collect()}
    for y in (0, 1):
        total = sizes[(y, "test")] + sizes[(y, "train")]
        assert abs(sizes[(y, "test")] - 0.2 * total) <= 1


def test_chained_lookups_read_their_input_once(spark, data):
    source = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey")
    df = source
    for i, k in enumerate(["l_orderkey", "l_partkey", "l_suppkey"]):
        table = source.groupBy(k).agg(F.count(F.lit(1)).alias(f"n{i}"))
        df = lk.lookup(df, [k], table, [f"n{i}"], weight=f"n{i}", small_rows=0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The source, and per lookup the written dictionary for its hot keys and for its join.
    assert plan.count("Relation [") == 1 + 2 * 3, plan
    assert df.where("n0 is null or n1 is null or n2 is null").isEmpty()


def test_distance_tiles_are_bounded():
    from autoprep.operators import knn

    rng = np.random.default_rng(1)
    q, b = rng.normal(size=(50, 3)), rng.normal(size=(70, 3))
    whole = knn._near(q, b, 4)
    cells, knn.TILE_CELLS = knn.TILE_CELLS, 150
    try:
        tiled = knn._near(q, b, 4)
    finally:
        knn.TILE_CELLS = cells
    assert [x.tolist() for x in whole] == [x.tolist() for x in tiled]
    for d in (1, 3, 16, 64):
        for n in (1000, 10**6, 10**9):
            rows = knn._block_rows(n, d, 8)
            assert max(1, knn.TILE_CELLS // rows) * rows <= knn.TILE_CELLS
