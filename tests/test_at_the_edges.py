"""Cases the driver tables do not hold: many partitions, large integers, infinities,
quotes, line breaks and tabs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeda.operators import adhoc, clean, explore, stats
from sparkeda.plans.facts import column_facts
from sparkeda.plans.quantiles import exact_quantiles
from sparkeda.plans.roles import auto_select_target
from sparkeda.sources import io


def test_global_index_is_whole_when_written(spark, tmp_path):
    n = 3_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.md5(F.col("id").cast("string")).alias("payload"))
    path = str(tmp_path / "idx")
    io.with_global_index(df, [F.col("k")]).write.parquet(path)
    got = spark.read.parquet(path)
    r = got.agg(F.count("*").alias("n"), F.count_distinct("__idx").alias("d"), F.max("__idx").alias("m"),
                F.count_if(F.col("__idx") != F.col("k")).alias("wrong")).collect()[0]
    assert (r["n"], r["d"], r["m"], r["wrong"]) == (n, n, n - 1, 0)


def test_large_integers_stay_apart(spark):
    df = spark.range(1000).select((F.col("id") + 2 ** 60).alias("id"),
                                  (F.col("id") % 3 + F.lit(2 ** 63 - 5)).cast("long").alias("top"),
                                  (F.col("id").cast("decimal(28,2)") + F.lit("100000000000000000000").cast("decimal(30,2)")).alias("d"))
    got = {r["column"]: r["distinct_count"] for r in column_facts(df).collect()}
    assert got == {"id": 1000, "top": 3, "d": 1000}


def test_quantiles_with_infinities(spark):
    inf = float("inf")
    vals = [float(x) for x in range(60_000)] + [inf] * 30 + [-inf] * 10 + [1.7e308, -1.7e308]
    df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(4)
    got = exact_quantiles(df, {"v": F.col("v")}, [0.0, 0.0001, 0.25, 0.5, 0.9999, 1.0], final_size=1000)
    order = np.sort(np.array(vals))
    for p, x in ((p, got[("v", p)]) for p in (0.25, 0.5)):
        assert math.isclose(x, np.quantile(order, p), rel_tol=1e-12)
    assert got[("v", 0.0)] == -inf and got[("v", 1.0)] == inf


def test_csv_keeps_quotes_line_breaks_and_blanks(spark, tmp_path):
    rows = [(1, 'a "quoted", word\nand a second line'), (2, " padded\t"), (3, "x,y"), (4, "back\\slash\r\nend")]
    io.write_csv(spark.createDataFrame(rows, "id long, t string"), str(tmp_path / "c"))
    got = io.read_table(spark, str(tmp_path / "c"), fmt="csv")
    assert got.dtypes == [("id", "bigint"), ("t", "string")]
    assert sorted(tuple(r) for r in got.collect()) == rows


def test_range_filters_reach_the_scan(spark, sf):
    lineitem = spark.read.parquet(f"{sf}/lineitem.parquet")
    for col, lo, hi in (("l_quantity", 10, 20.5), ("l_orderkey", 10.5, 500)):
        df = explore.filter_range(lineitem, col, lo, hi)
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert f"GreaterThanOrEqual({col}" in pushed and f"LessThanOrEqual({col}" in pushed
        assert df.count() == lineitem.filter((F.col(col) >= lo) & (F.col(col) <= hi)).count()
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert [r["v"] for r in explore.filter_range(nan, "v", lo=0).collect()] == [1.0]


def test_run_sql_keeps_the_statements_order(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows, facts = adhoc.run_sql(orders, "SELECT o_orderkey, o_totalprice FROM dataset ORDER BY o_totalprice DESC;", 2, 100)
    want = [r["o_totalprice"] for r in orders.orderBy(F.desc("o_totalprice")).collect()][100:200]
    assert [r["o_totalprice"] for r in rows.collect()] == want
    assert facts.collect()[0]["total_rows"] == orders.count()
    for bad in ("DROP TABLE x", "INSERT INTO t SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            adhoc.run_sql(orders, bad)


def test_words_are_trimmed_of_all_white_space(spark):
    df = spark.createDataFrame([("\tYes",), ("no\t",), ("yes ",), (None,)], "w string")
    assert [r["w"] for r in clean.parse_boolean_words(df).collect()] == [1, 0, 1, None]


def test_imbalance_of_an_empty_column(spark):
    r = stats.imbalance_summary(spark.createDataFrame([(None,)], "c string"), "c").collect()[0]
    assert (r["total"], r["classes"], r["majority_share"], r["minority_share"], r["imbalance_ratio"]) == (0, 0, None, None, None)


def test_auto_select_target(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b", "xyz"[i % 3], "k") for i in range(300)],
                               "id long, rare string, even string, one string")
    assert auto_select_target(df).collect()[0]["column"] == "even"
    assert auto_select_target(df.select("id", "one")).count() == 0
