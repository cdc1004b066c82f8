import math

import pytest
from pyspark.sql import functions as F

from autoprep.operators import clean as c
from autoprep.operators.detect import detect
from autoprep.sources.tables import read_table, write_predictions


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


@pytest.fixture(scope="module")
def messy(spark):
    rows = []
    days = ["2024-01-15", "15/01/2024", "2024/01/15", "15-Jan-2024"]
    for i in range(60):
        rows.append((
            i, "$1,234.56" if i % 2 else "1,000.00", "45.2%" if i % 3 else "10", days[i % 4],
            math.inf if i % 20 == 0 else -math.inf if i % 20 == 1 else float(i), f"c{i:03d}", float(i),
            ["a", "b", "M", "mujer"][i % 4], i % 2 == 0,
        ))
    return spark.createDataFrame(
        rows, "i int, monto string, tasa string, fecha string, senal double, id_cliente string, valor double, categoria string, activo boolean"
    )


def test_full_cleaning(messy):
    out, log = c.clean(messy)
    assert column(out, "monto")[:2] == [1000.0, 1234.56]
    assert column(out, "tasa")[:2] == [0.1, pytest.approx(0.452)]
    assert set(column(out, "fecha_año")) == {2024.0} and set(column(out, "fecha_mes")) == {1.0}
    assert set(column(out, "fecha_dia")) == {15.0} and set(column(out, "fecha_diasemana")) == {0.0}
    assert "fecha" not in out.columns
    assert column(out, "senal")[:3] == [None, None, 2.0]
    assert column(out, "categoria")[:4] == ["a", "b", "masculino", "femenino"]
    assert column(out, "activo")[:2] == [1, 0]
    assert {tuple(r) for r in log.collect()} == {
        ("monto", "parsed_currency"), ("tasa", "parsed_pct"), ("fecha", "parsed_dates"), ("senal", "inf_handled"),
        ("id_cliente", "ids_detected"), ("categoria", "normalized_cats"), ("activo", "bools_converted"),
    }


def test_plan_replays_on_other_rows(spark, messy):
    plan = c.fit_clean(messy)
    again = c.CleaningPlan.from_dict(plan.to_dict())
    new = spark.createDataFrame([(1, "$2.50", "7%", "bad", 1.0, "x", -5.0, "Male", None)], messy.schema)
    row = again.transform(new).first()
    assert (row["monto"], row["tasa"], row["fecha_año"], row["categoria"]) == (2.5, pytest.approx(0.07), 2024.0, "masculino")


def test_null_tokens_any_case(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["N/A", " na ", "?", "--", "", "ok", None])], "i int, x string")
    assert column(c.normalize_nulls(df), "x") == [None] * 5 + ["ok", None]


def test_money_needs_the_sign_at_the_start(spark):
    df = spark.createDataFrame([(0, "costo $100", 1), (1, "vale $5", 2), (2, "precio $7", 3)], "i int, descripcion string, precio int")
    assert column(c.quick_clean(df), "descripcion") == ["costo $100", "vale $5", "precio $7"]


def test_one_stray_sign_does_not_turn_a_text_column(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") == 7, "up 5%").otherwise(F.concat(F.lit("note "), "id")).alias("x"))
    assert not detect(df)["x"].is_percent


def test_short_date_list_is_no_currency(spark):
    df = spark.createDataFrame([(0, "2024-01-15"), (1, "15/01/2024"), (2, "2024/01/15")], "i int, fecha string")
    assert column(c.clean(df)[0], "fecha") == ["2024-01-15", "15/01/2024", "2024/01/15"]


@pytest.mark.parametrize("text,day", [
    ("2024-01-15", "2024-01-15"), ("5/1/2024", "2024-01-05"), ("01/13/2024", "2024-01-13"), ("20240115", "2024-01-15"),
    ("15-jan-2024", "2024-01-15"), ("2024-01-15 10:30:00", "2024-01-15"), ("2024-01-15T10:30:00", "2024-01-15"),
    ("15/01/24", None), ("12:30", None), ("2024", None), ("now", None), ("31/02/2024", None),
])
def test_date_spellings(spark, text, day):
    df = spark.createDataFrame([(text,)], "x string")
    found = c.parse_dates(df, ["x"]).select(F.to_date("x").cast("string")).first()[0]
    assert found == day


def test_unparseable_dates_become_identifier(spark):
    df = spark.createDataFrame([(i, "2024-01-15" if i < 4 else f"lot 2024-99-{i:02d}") for i in range(20)], "i int, x string")
    facts = detect(df)["x"]
    assert c.date_verdict(facts) == "id" and facts.rule() == "id"


def test_rare_negatives(spark):
    few = spark.range(100).select(F.col("id").alias("i"), F.when(F.col("id") < 3, -1.0).otherwise(5.0).alias("margen"))
    assert column(c.quick_clean(few), "margen")[:4] == [None, None, None, 5.0]
    many = spark.range(100).select(F.col("id").alias("i"), F.when(F.col("id") < 5, -1.0).otherwise(5.0).alias("balance"))
    assert column(c.quick_clean(many), "balance")[:5] == [-1.0] * 5


@pytest.mark.parametrize("share,capped", [(0.03, True), (0.005, False), (0.15, False)])
def test_outlier_capping(spark, share, capped):
    n = 1000
    df = spark.range(n).select("id", F.when(F.col("id") < share * n, 500.0).otherwise(F.col("id") % 20 + 10.0).alias("valor"))
    top = c.cap_outliers(df, ["valor"]).agg(F.max("valor")).first()[0]
    assert (top < 500) is capped


def test_capping_keeps_nulls(spark):
    df = spark.createDataFrame([(i, None if i == 0 else 1000.0 if i < 4 else float(i % 7)) for i in range(100)], "i int, v double")
    assert column(c.cap_outliers(df, ["v"]), "v")[0] is None


def test_identifiers_and_duplicates(spark):
    df = spark.createDataFrame([(f"k{i}", "a" if i % 2 else None) for i in range(40)], "code string, kind string")
    assert c.detect_ids(df) == ["code"] and c.drop_ids(df).columns == ["kind"]
    assert c.dedup(df.drop("code")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,fecha,precio,nota\n1,2024-01-15,$5.00,N/A\n2,2024-01-16,$6.00,hola\n")
    df = read_table(spark, str(path))
    assert column(df, "nota", "id") == [None, "hola"] and dict(df.dtypes)["precio"] == "string"
    write_predictions(df, str(tmp_path / "out"), "csv", ["precio"])
    again = read_table(spark, str(tmp_path / "out"), "csv")
    assert again.columns[0] == "precio" and again.count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "table.xlsx")


def test_csv_with_line_breaks_in_quotes_and_null_tokens(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('id,note,amount,big,when\n1,"a\nb, ""c""",3,5000000000,2024-01-15\n2,c,NA,7,\n')
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"id": "int", "note": "string", "amount": "int", "big": "bigint", "when": "date"}
    assert [(r.id, r.note, r.amount) for r in df.orderBy("id").collect()] == [(1, 'a\nb, "c"', 3), (2, "c", None)]
