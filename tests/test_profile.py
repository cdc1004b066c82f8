import numpy as np
import pytest
from pyspark.sql import functions as F

from autoprep.operators import profile as p
from autoprep.plans import recommend as rec


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_semantic_types(spark):
    df = spark.createDataFrame(
        [(i % 3 + 1, bool(i % 2), f"t{i}", float(i)) for i in range(24)], "score int, flag boolean, text string, x double"
    )
    got = by_column(p.profile_columns(df))
    assert got["score"]["type"] == "categorical_numeric" and got["flag"]["type"] == "categorical_numeric"
    assert got["text"]["type"] == "categorical" and got["x"]["type"] == "numeric"
    x = np.arange(24.0)
    assert got["x"]["std_value"] == pytest.approx(x.std(ddof=1))


def test_skew_is_bias_corrected(spark):
    x = np.array([1.0, 2.0, 2.0, 3.0, 10.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    n, d = len(x), x - x.mean()
    g1 = (d ** 3).mean() / (d ** 2).mean() ** 1.5
    assert by_column(p.profile_columns(df))["x"]["skew_value"] == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2))
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert by_column(p.profile_columns(two))["x"]["skew_value"] is None


def test_not_a_number_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    got = by_column(p.profile_columns(df))["x"]
    assert (got["nulls"], got["unique_count"], got["max_value"]) == (2, 1, 1.0)


def test_empty_table(spark):
    got = by_column(p.profile_columns(spark.createDataFrame([], "x double, t string")))
    assert got["x"]["n_rows"] == 0 and got["x"]["null_pct"] == 0 and got["t"]["unique_count"] == 0


def test_approximate_profile_keeps_the_verdicts(spark, data):
    df = spark.read.parquet(f"{data}/lineitem.parquet")
    exact, approx = by_column(p.profile_columns(df)), by_column(p.profile_columns(df, approx=True))
    assert {c: r["type"] for c, r in exact.items()} == {c: r["type"] for c, r in approx.items()}
    for c, r in exact.items():
        assert approx[c]["unique_count"] == pytest.approx(r["unique_count"], rel=0.05)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i), 2.0 * i) for i in range(5)], "a double, b double, c double")
    got = {(r["col1"], r["col2"]): r["r"] for r in p.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and got[("b", "c")] == pytest.approx(1.0)
    assert [tuple(r) for r in p.high_corr_pairs(p.correlations(df, ["a", "b", "c"])).collect()] == [("b", "c", 1.0)]


def counts(spark, *sizes):
    return spark.createDataFrame([(k, float(i)) for k, n in enumerate(sizes) for i in range(n)], "y int, x double")


@pytest.mark.parametrize("sizes,level,strategy,concentration", [
    ((50, 50), "balanced", "none", "moderate"),
    ((50, 30), "mild", "class_weight", "severe"),
    ((80, 20), "moderate", "smote", "severe"),
    ((90, 10), "severe", "smote_enn", "extreme"),
    ((190, 10), "extreme", "adasyn", "extreme"),
])
def test_balance_levels(spark, sizes, level, strategy, concentration):
    row = p.target_profile(counts(spark, *sizes), "y").first()
    assert (row["balance_level"], row["balance_strategy"], row["concentration_level"]) == (level, strategy, concentration)
    assert row["sentinel_majority"] is (row["majority_pct"] > 60)


def test_target_errors_and_absence(spark):
    with pytest.raises(KeyError):
        p.target_profile(counts(spark, 2), "nothing")
    assert p.target_profile(counts(spark, 2), None).first()[0] == ["clustering", "dimensionality_reduction"]


def test_discrete_regression_becomes_classification(spark):
    t = p.target_profile(counts(spark, 498, 2), "y")
    assert rec.recommend_task(t, "regression").first()["task"] == "classification"
    assert rec.recommend_balance(t, "regression").first()["balance"] == "smote"
    one = p.target_profile(counts(spark, 98, 1), "y")
    assert rec.recommend_balance(one).first()["balance"] == "class_weight"
    wide = spark.range(200).select((F.col("id") * 1.5).alias("y"))
    assert rec.recommend_task(p.target_profile(wide, "y"), None).first()["task"] == "regression"


def test_column_rules(spark):
    rows = [(float(i), float(i) if i % 2 else None, 2.0 ** (i % 12) if i % 10 else None, None if i % 3 else 1.0, f"u{i}", "abc"[i % 3],
             "ab"[i % 2], f"c{i % 20}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "full double, half double, skewed double, sparse double, unique string, low string, two string, many string, target int")
    got = by_column(rec.recommend_columns(p.profile_columns(df, "target")))
    assert (got["full"]["impute"], got["half"]["impute"], got["skewed"]["impute"], got["sparse"]["impute"]) == ("none", "mean", "median", "drop")
    assert (got["unique"]["encode"], got["low"]["encode"], got["two"]["encode"], got["many"]["encode"]) == ("drop", "onehot", "label", "target")
    assert got["full"]["scale"] == "standard" and got["sparse"]["scale"] == "none"
    assert got["target"]["impute"] is None and got["target"]["scale"] is None


def test_correlations_read_the_table_once(spark, capsys):
    import numpy as np

    from autoprep.operators.profile import correlations

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 300)) + 1e6
    x[:, 1] = 2 * x[:, 0] + 1
    x[:, 2] = 0.1
    x[rng.random(x.shape) < 0.05] = np.nan
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"`{c}` double" for c in names))
    out = correlations(df, names)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan") == 1
    got = {(r["col1"], r["col2"]): r["r"] for r in out.collect()}
    assert len(got) == 300 * 299 // 2 and got["c0", "c1"] == pytest.approx(1.0) and got["c0", "c2"] is None
    for a, b in ((0, 3), (5, 250), (298, 299)):
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert got[f"c{a}", f"c{b}"] == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1], abs=1e-9)


def test_shares_are_rounded_from_counts(spark):
    from pyspark.sql import functions as F

    from autoprep.functions.columns import share

    df = spark.createDataFrame([(9, 60_000), (15, 100_000), (25, 100_000), (1, 3), (0, 5), (5, 0), (7, 7)], "a bigint, b bigint")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", share(F.col("a"), F.col("b"), 4).alias("s")).collect()}
    assert got == {(9, 60_000): 0.0002, (15, 100_000): 0.0002, (25, 100_000): 0.0002, (1, 3): 0.3333, (0, 5): 0.0, (5, 0): None, (7, 7): 1.0}
