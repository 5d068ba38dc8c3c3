"""Distributed exact quantiles equal numpy's linear interpolation, including
hot values and several narrowing passes."""

import numpy as np
from pyspark.sql import functions as F

from sparkeda.plans.quantiles import exact_quantiles


def test_against_numpy_with_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 1, 6000), np.full(3000, 0.25), rng.exponential(3, 1000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, {"v": F.col("v")}, probs, buckets=16, final_size=50)
    for p in probs:
        assert np.isclose(got[("v", p)], np.quantile(vals, p), rtol=0, atol=1e-12)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(None,), (3.0,)], "v double")
    got = exact_quantiles(df, {"v": F.col("v"), "w": F.lit(None).cast("double")}, [0.5])
    assert got[("v", 0.5)] == 3.0 and got[("w", 0.5)] is None
