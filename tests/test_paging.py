"""Pages by top-n and by key search equal slices of the sorted rows; run_sql and names."""

import random

import pytest
from pyspark.sql import functions as F

from sparkeda.operators import adhoc as ad
from sparkeda.operators import explore as ex


def _rows(n=700, seed=2):
    r = random.Random(seed)
    return [(i, r.choice([None, 1.5, 2.0, float("nan"), -3.0, 7.25]), r.choice([None, "a", "b", "B", ""]), r.randrange(4)) for i in range(n)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("sort_by", ["v", "t", "k", None])
def test_deep_pages_equal_the_sorted_rows(spark, monkeypatch, sort_by, order):
    monkeypatch.setattr(ex, "_SHALLOW", 40)
    df = spark.createDataFrame(_rows(), "id long, v double, t string, k int").repartition(4)
    want = [r["id"] for r in ex.sort_rows(df, sort_by, order, ["k", "id"]).collect()]
    for page in (1, 2, 9, 35, 69, 70, 71):
        rows, meta = ex.paginate(df, page, 10, sort_by, order, ["k", "id"])
        assert [r["id"] for r in rows.collect()] == want[(page - 1) * 10:page * 10], page
        m = meta.collect()[0]
        assert (m["total_rows"], m["total_pages"], m["has_next"], m["has_prev"]) == (700, 70, page < 70, page > 1)


def test_equal_rows_and_timestamps(spark, monkeypatch):
    monkeypatch.setattr(ex, "_SHALLOW", 30)
    same = spark.range(300).select(F.lit("x").alias("a"), F.lit(1).alias("b"))
    assert ex.paginate(same, 20, 10)[0].count() == 10
    df = spark.range(400).select("id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 200)").alias("ts"))
    want = [r["id"] for r in ex.sort_rows(df, "ts", "desc", ["id"]).collect()]
    assert [r["id"] for r in ex.paginate(df, 25, 10, "ts", "desc", ["id"])[0].collect()] == want[240:250]


def test_first_page_is_a_top_n_and_deep_pages_read_a_range(spark, tmp_path):
    spark.range(60_000).select("id", (F.col("id") * 7919 % 60_000).alias("k")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    first = _plan(ex.paginate(df, 1, 50, "k", "asc", ["id"])[0])
    assert "TakeOrderedAndProject" in first and "rangepartitioning" not in first and "ExistingRDD" not in first
    rows, _ = ex.paginate(df, 1000, 50, "k", "asc", ["id"])
    plan = _plan(rows)
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "GreaterThanOrEqual(k" in plan
    assert [r["k"] for r in rows.collect()] == list(range(49_950, 50_000))


def test_sql_names_and_texts(spark):
    df = spark.range(30).withColumn("t", F.lit(") update"))
    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("dataset")
    rows, _ = ad.run_sql(df, "SELECT id, 'dataset' AS d FROM Dataset WHERE t = ') update' AND dataset.id >= 0 -- dataset\nORDER BY id DESC;", 1, 10)
    assert [(r["id"], r["d"]) for r in rows.collect()] == [(i, "dataset") for i in range(29, 19, -1)]
    assert spark.table("dataset").columns == ["mine"]
    assert "TakeOrderedAndProject" in _plan(rows)
    for bad in ("WITH x AS (SELECT 1) INSERT INTO y SELECT * FROM x", "DROP TABLE x"):
        with pytest.raises(ValueError):
            ad.run_sql(df, bad)
    spark.catalog.dropTempView("dataset")
