"""Quantiles of many columns in one state table, and facts shared between analyses."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkeda.operators import outliers as ou
from sparkeda.operators import stats as st
from sparkeda.plans import quantiles as qt


def test_a_thousand_columns_bring_back_one_row_per_rank(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(60, 1000)) * 10.0 ** r.integers(-3, 6, 1000), 3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(1000)])).repartition(2)
    passes = []
    narrow = qt._narrow
    monkeypatch.setattr(qt, "_narrow", lambda long, n, state, buckets: (passes.append(len(state)), narrow(long, n, state, buckets)))
    got = qt.exact_quantiles(df, {c: F.col(c) for c in df.columns}, [0.25, 0.5], buckets=8, final_size=10)
    assert max(passes) <= 4 * 1000 and len(passes) <= 5
    for i in range(0, 1000, 37):
        for p in (0.25, 0.5):
            assert np.isclose(got[f"c{i}", p], np.quantile(x[:, i], p), rtol=1e-13, atol=0)


def test_odd_values(spark):
    tiny = float(np.nextafter(1.0, 2.0))
    cols = {"inf": [float("-inf"), 1.0, 2.0, float("inf"), float("inf")], "same": [4.0] * 5, "near": [1.0, tiny, 1.0, tiny, tiny],
            "huge": [-1.7e308, 1.7e308, 0.0, 1.6e308, -1.6e308], "some": [None, 3.0, None, float("nan"), 5.0], "none": [None] * 5}
    rows = list(zip(*cols.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    nan_free = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    got = qt.exact_quantiles(df, nan_free, probs, buckets=2, final_size=1)
    for c, v in cols.items():
        v = np.sort([x for x in v if x is not None and not np.isnan(x)])
        for p in probs:
            if not len(v):
                assert got[c, p] is None
                continue
            at = p * (len(v) - 1)
            lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
            want = lo if lo == hi or at == int(at) else lo * (1 - at % 1) + hi * (at % 1)
            assert got[c, p] == want or np.isclose(got[c, p], want, rtol=1e-15)


def test_analyses_share_their_facts(spark, monkeypatch):
    r = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"a": r.normal(size=300), "b": r.integers(0, 9, 300).astype(float)})).withColumn("e", F.lit(None).cast("double"))
    cols = ["a", "b", "e"]
    alone = [f(df, cols).collect() for f in (st.numeric_stats, ou.outlier_summary, ou.box_summary)]
    calls = []
    search = qt.exact_quantiles
    monkeypatch.setattr(qt, "exact_quantiles", lambda *a, **k: (calls.append(1), search(*a, **k))[1])
    facts = qt.NumericFacts(df, cols)
    shared = [f(df, cols, facts=facts).collect() for f in (st.numeric_stats, ou.outlier_summary, ou.box_summary)]
    assert shared == alone and len(calls) == 1
    t = {r_["column"]: r_ for r_ in shared[0]}
    assert t["e"]["count"] == 0 and t["e"]["median"] is None and t["a"]["missing"] == 0
    a = df.toPandas()["a"]
    q1, q3 = a.quantile(0.25), a.quantile(0.75)
    out = ((a < q1 - 1.5 * (q3 - q1)) | (a > q3 + 1.5 * (q3 - q1))).sum()
    assert {r_["column"]: r_["iqr_outliers"] for r_ in shared[1]}["a"] == out
