import numpy as np
import pandas as pd
import pytest

from autoprep.operators import transform as tf


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame(
        [(0, 1.0, "b", 10.0), (1, None, "a", 20.0), (2, 5.0, None, 30.0), (3, 9.0, "a", 60.0)], "i int, v double, t string, y double"
    )


@pytest.mark.parametrize("method,value", [("mean", 5.0), ("median", 5.0), ("zero", 0.0), ("mode", 1.0)])
def test_imputation(gaps, method, value):
    out = tf.Imputer.fit(gaps, {"v": method}).transform(gaps)
    assert column(out, "v") == [1.0, value, 5.0, 9.0] and column(out, "v_is_missing") == [0, 1, 0, 0]


def test_imputation_keeps_integers_precise(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    out = tf.Imputer.fit(df, {"v": "mean"}).transform(df)
    assert sorted(r["v"] for r in out.collect()) == [1.0, 1.5, 2.0]


def test_dropping_rows(gaps):
    assert tf.Imputer.fit(gaps, {"v": "drop"}).transform(gaps).count() == 3


def test_encoders_and_unseen_values(spark, gaps):
    new = spark.createDataFrame([(0, 1.0, "a", 1.0), (1, 1.0, "new", 1.0), (2, 1.0, None, 1.0)], gaps.schema)
    assert column(tf.LabelEncode.fit(gaps, ["t"]).transform(gaps), "t") == [1.0, 0.0, 2.0, 0.0]
    assert column(tf.LabelEncode.fit(gaps, ["t"]).transform(new), "t") == [0.0, -1.0, 2.0]
    assert column(tf.TargetEncode.fit(gaps, ["t"], "y").transform(new), "t") == [40.0, 30.0, 30.0]
    assert column(tf.FrequencyEncode.fit(gaps, ["t"]).transform(new), "t") == [2.0, 0.0, 0.0]
    hot = tf.OneHot.fit(gaps, ["t"]).transform(new)
    assert column(hot, "t_b") == [0.0, 0.0, 0.0] and column(hot, "t_nan") == [0.0, 0.0, 1.0] and "t_a" not in hot.columns


def test_encoding_a_column_named_like_the_dictionary(spark):
    df = spark.createDataFrame([(0, "x", 1.0), (1, "y", 3.0)], "i int, key string, value double")
    assert column(tf.TargetEncode.fit(df, ["key"], "value").transform(df), "key") == [1.0, 3.0]


def test_scalers(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(i, float(v), 3.0) for i, v in enumerate(x)], "i int, x double, flat double")
    assert column(tf.Scale.fit(df, ["x", "flat"], "standard").transform(df), "x") == pytest.approx((x - x.mean()) / x.std())
    assert column(tf.Scale.fit(df, ["x"], "minmax").transform(df), "x") == pytest.approx((x - 1) / 8)
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    assert column(tf.Scale.fit(df, ["x"], "robust").transform(df), "x") == pytest.approx((x - q2) / (q3 - q1))
    for method in ("standard", "minmax", "robust"):
        assert column(tf.Scale.fit(df, ["flat"], method).transform(df), "flat") == [0.0] * 4
    with pytest.raises(ValueError):
        tf.Scale.fit(df, ["x"], "other")


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 0.25, 0.5, 0.75, 1.0], [5, 5, 5]])
def test_bins_match_equal_width_cut(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    expected = pd.cut(pd.Series(values, dtype=float), bins=4, labels=False).tolist()
    assert column(tf.Bin.fit(df, "x", 4).transform(df), "x_bin") == expected


def test_feature_operators(spark):
    df = spark.createDataFrame(
        [(0, -3.0, "a", "Oferta ya", "2024-01-02 01:00:00", "2024-01-01 02:00:00"), (1, 4.0, "a", None, None, "2024-01-01 00:00:00"),
         (2, 2.0, None, "nada", "2024-01-01 00:00:00", "2024-01-02 01:00:00")],
        "i int, x double, g string, t string, a string, b string",
    ).selectExpr("i", "x", "g", "t", "timestamp(a) a", "timestamp(b) b")
    assert column(tf.log1p_feature(df, "x"), "x_log") == pytest.approx([0.0, np.log1p(4), np.log1p(2)])
    assert column(tf.Ratio.fit(df, "x", "g", "r").transform(df), "r") == [-6.0, 8.0, 1.0]
    assert column(tf.Ratio.fit(df, "x", None, "r").transform(df), "r") == [-3.0, 4.0, 2.0]
    assert column(tf.str_len(df, "t", "n"), "n") == [9, 0, 4]
    assert column(tf.keyword(df, "t", "oferta", "k"), "k") == [1, 0, 0]
    assert column(tf.date_diff(df, "a", "b", "d"), "d") == [0, 0, -2]
    assert column(tf.interact(df, "x", "i", "p"), "p") == [0.0, 4.0, 4.0]


def test_useless_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0, 1e-7 * i, "c", None) for i in range(5)], "a double, b double, c double, d string, e string")
    assert tf.constant_columns(df) == ["b", "d", "e"]
    assert tf.near_zero_variance(df) == ["b", "c"]


def test_target_codes(spark):
    df = spark.createDataFrame([(0, "yes"), (1, "no"), (2, None)], "i int, y string")
    classes = tf.target_classes(df, "y")
    coded = tf.encode_target(df, "y", classes)
    assert classes == ["no", "yes"] and column(coded, "label") == [1.0, 0.0, None]
    assert column(tf.decode_target(coded, "label", classes, "back"), "back") == ["yes", "no", None]
