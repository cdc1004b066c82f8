from autoprep.sources.tables import read_table


def test_long_whole_numbers_stay_apart(spark, tmp_path):
    path = tmp_path / "keys.csv"
    path.write_text("id,big,number,small\n1234567890123456789,12345678901234567890,1.5,-2147483648\n1234567890123456788,12345678901234567891,2,5\n-9223372036854775808,3,4e3,6\n")
    df = read_table(spark, str(path))
    assert [dict(df.dtypes)[c] for c in ("id", "big", "number", "small")] == ["bigint", "string", "double", "int"]
    assert df.select("id").distinct().count() == 3 and df.select("big").distinct().count() == 3
