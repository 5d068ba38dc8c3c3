"""Gram correlation, capped distinct counts and bucketed windows against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkeda.operators import correlation as co
from sparkeda.operators import distribution as di
from sparkeda.operators import timeseries as tsr


def _as_matrix(rows, cols):
    got = {(r["col1"], r["col2"]): r["corr"] for r in rows}
    return np.array([[np.nan if got[a, b] is None else got[a, b] for b in cols] for a in cols])


def _table(n=400, d=12, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) + r.normal(size=(n, 1))
    x[:, 1] = 1e9 + x[:, 1]                                       # large mean, small spread
    x[:, 2] = 7.1                                                 # constant
    x[r.random((n, d)) < 0.2] = np.nan
    x[:, 3] = np.where(np.arange(n) % 2 == 0, 0.3, r.normal(size=n))
    x[np.arange(n) % 2 == 1, 4] = np.nan                          # 3 is constant where 4 is there
    x[:, 5] = np.nan
    return pd.DataFrame(x, columns=[f"x{i}" for i in range(d)])


def test_gram_equals_pairwise_correlation(spark):
    t = _table()
    df = spark.createDataFrame(t.astype(object).where(t.notna(), None), ", ".join(f"{c} double" for c in t.columns)).repartition(5)
    want = t.corr(min_periods=2).to_numpy()
    want[2, :] = want[:, 2] = want[3, 4] = want[4, 3] = np.nan
    few = _as_matrix(co.correlation_matrix(df, list(t.columns)).collect(), t.columns)
    gram = _as_matrix(co.correlation_matrix(df, list(t.columns), few_pairs=0).collect(), t.columns)
    for got in (few, gram):
        np.testing.assert_allclose(np.delete(got, 1, 0), np.delete(want, 1, 0), atol=1e-7, equal_nan=True)
    np.testing.assert_allclose(gram, few, atol=1e-7, equal_nan=True)


def test_three_hundred_columns_take_one_scan(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 300)) + 0.5 * r.normal(size=(300, 1))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(300)])).repartition(3)
    got = co.correlation_matrix(df, df.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") + plan.count("Scan ") <= 2 and "PythonMapInArrow" in plan or "MapInArrow" in plan
    np.testing.assert_allclose(_as_matrix(got.collect(), df.columns), np.corrcoef(x.T), atol=1e-9)


def test_usable_columns_and_few_distinct(spark):
    df = spark.range(500).select((F.col("id") % 61).alias("d61"), (F.col("id") % 60).alias("d60"), F.lit(4).alias("one"),
                                 F.when(F.col("id") < 2, F.col("id")).alias("two_rows"), F.lit(None).cast("int").alias("none"), "id")
    assert co.usable_columns(df, df.columns) == ["d61", "d60", "id"]
    assert di.few_distinct(df.repartition(6), 60) == {"d60": 60, "one": 1, "two_rows": 2, "none": 0}
    plan = df.select(F.col("id")).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


@pytest.mark.parametrize("n", [5, 8, 11, 40, 300])
def test_moving_average_over_bucket_borders(spark, monkeypatch, n):
    monkeypatch.setattr(tsr, "_BUCKET", 16)
    t = pd.DataFrame({"k": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "v": np.random.default_rng(n).normal(size=n)})
    df = spark.createDataFrame(t)
    w = tsr.moving_average_width(n)
    want = t["v"].rolling(w, center=True).mean().to_numpy() if w else np.full(n, np.nan)
    got = tsr.centered_moving_average(df, "ts", "v", "k").orderBy("key").toPandas()["trend"].astype(float).to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-12, equal_nan=True)
    many = df.withColumn("s", F.lit("hot")).union(df.withColumn("s", F.lit("b"))).union(df.filter("k < 9").withColumn("s", F.lit("c")))
    got = tsr.centered_moving_average(many, "ts", "v", "k", ["s"]).toPandas()
    for s, m in (("hot", n), ("b", n), ("c", min(n, 9))):
        part = got[got.s == s].sort_values("key")
        w = tsr.moving_average_width(m)
        want = t["v"][:m].rolling(w, center=True).mean().to_numpy() if w else np.full(m, np.nan)
        np.testing.assert_allclose(part["trend"].astype(float).to_numpy(), want, atol=1e-12, equal_nan=True)


def test_only_border_rows_are_copied(spark):
    idx = spark.range(100_000).withColumnRenamed("id", "p")
    assert tsr._with_halo(idx, "p", 6).count() < 1.01 * 100_000
