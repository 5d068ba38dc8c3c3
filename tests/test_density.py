"""The density curve equals the direct sum over all values."""

import numpy as np
import pytest


@pytest.mark.parametrize("kind", ["prices", "heavy", "gap", "few"])
def test_curve_equals_the_direct_sum(spark, sf, kind):
    r = np.random.default_rng(3)
    if kind == "prices":
        df = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("cast(l_extendedprice as double) v")
    else:
        x = {"heavy": r.standard_t(1.5, 3000) * 100 - 7, "gap": np.concatenate([r.normal(0, 1, 900), r.normal(60, 1, 900)]),
             "few": np.array([3.0, 4.0, 4.0])}[kind]
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    from sparkeda.operators.distribution import kde_curve
    v = np.array([r_["v"] for r_ in df.collect() if r_["v"] is not None and not np.isnan(r_["v"])])
    got = kde_curve(df, "v").orderBy("point").collect()
    h = v.std(ddof=1) * len(v) ** -0.2
    for g in got[::7]:
        want = np.exp(-0.5 * ((g["x"] - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))
        assert abs(g["density"] - want) <= 1e-9 * want
    assert len(got) == 200 and got[0]["x"] == v.min()
