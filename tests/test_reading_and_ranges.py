"""Reading CSV exactly, refusing empty tables, range bounds that reach the scan."""

import decimal

import pytest
from pyspark.sql import functions as F

from sparkeda.operators.explore import filter_range
from sparkeda.sources import io


def _csv(path, text):
    path.mkdir()
    (path / "a.csv").write_text(text)
    return str(path)


def test_long_ids_stay_exact(spark, tmp_path):
    ids = [2 ** 60 + i for i in range(1000)]
    text = "id,wide,mixed,f\n" + "".join(f"{i},{i * 1000},{i if i % 2 else str(i) + '.5'},{i}e1\n" for i in ids)
    got = io.read_table(spark, _csv(tmp_path / "c", text), fmt="csv")
    assert dict(got.dtypes) == {"id": "bigint", "wide": "decimal(38,0)", "mixed": "double", "f": "double"}
    assert {r["id"] for r in got.collect()} == set(ids)
    assert {int(r["wide"]) for r in got.collect()} == {i * 1000 for i in ids}
    edge = io.read_table(spark, _csv(tmp_path / "e", f"a,b\n{2 ** 63 - 1},{2 ** 63}\n{-2 ** 63},1\n"), fmt="csv")
    assert dict(edge.dtypes) == {"a": "bigint", "b": "decimal(38,0)"}


def test_empty_tables_are_refused(spark, tmp_path):
    head = _csv(tmp_path / "h", "a,b\n")
    with pytest.raises(ValueError, match="empty"):
        io.read_table(spark, head, fmt="csv")
    with pytest.raises(ValueError, match="empty"):
        io.read_table(spark, head, fmt="csv", schema="a int, b int")
    assert io.read_table(spark, head, fmt="csv", allow_empty=True).columns == ["a", "b"]
    spark.range(0).write.parquet(str(tmp_path / "p.parquet"))
    with pytest.raises(ValueError, match="empty"):
        io.read_table(spark, str(tmp_path / "p.parquet"))


def test_files_are_read_in_splits_unless_a_field_spans_lines(spark, tmp_path):
    plain = _csv(tmp_path / "p", "a,b\n" + '1,"x ""y"" z"\n' * 20000)
    assert not io.has_line_breaks_in_fields(spark, plain)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = io.read_table(spark, plain, fmt="csv")
        assert got.rdd.getNumPartitions() > 3 and got.count() == 20000
        assert got.first()["b"] == 'x "y" z'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    broken = _csv(tmp_path / "b", 'a,b\n1,"two\nlines"\n2,one\n')
    assert [r["b"] for r in io.read_table(spark, broken, fmt="csv").orderBy("a").collect()] == ["two\nlines", "one"]


VALUES = [-2 ** 63, -2 ** 53 - 1, -2 ** 31, -1, 0, 1, 2 ** 31, 2 ** 53, 2 ** 53 + 1, 2 ** 62 + 1, 2 ** 63 - 1]


@pytest.mark.parametrize("lo,hi", [(2 ** 53 + 1, None), (None, -2 ** 53 - 1), (2 ** 31, 2 ** 62), (0.5, 1.5), (None, 1e30),
                                   (-1e30, 0), (1e30, None), (float("-inf"), float("inf")), (2 ** 62 + 1, 2 ** 62 + 1)])
def test_ranges_on_longs_are_exact(spark, lo, hi):
    df = spark.createDataFrame([(v,) for v in [*VALUES, None]], "v long")
    want = [v for v in VALUES if (lo is None or v >= lo) and (hi is None or v <= hi)]
    assert sorted(r["v"] for r in filter_range(df, "v", lo, hi).collect()) == want


def test_range_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select(F.col("id").alias("l"), F.col("id").cast("float").alias("f"), F.col("id").cast("decimal(15,3)").alias("d"),
                             F.col("id").cast("double").alias("x"), F.col("id").cast("short").alias("s")).write.parquet(path)
    df = spark.read.parquet(path)
    for c in df.columns:
        got = filter_range(df, c, 10, 2 ** 31 + 0.25 if c != "s" else 20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters"):]
        assert f"GreaterThanOrEqual({c},10" in pushed and f"LessThanOrEqual({c}," in pushed, pushed
        assert got.count() == (990 if c != "s" else 11)
    assert filter_range(df, "d", decimal.Decimal("9.9995"), 10.0001).count() == 1
    floats = spark.createDataFrame([(0.1,), (0.2,), (float("nan"),), (None,)], "f float")
    assert filter_range(floats, "f", 0.1, 0.2).count() == 1       # the float 0.2 lies above the double 0.2
    assert filter_range(floats, "f", 0, 1e300).count() == 2
