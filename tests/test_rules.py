"""Role and cleaning rules at their thresholds, on hand-made frames."""

import math

from pyspark.sql import functions as F

from sparkeda.operators import clean as cl
from sparkeda.operators import stats as st
from sparkeda.plans import roles as ro


def _roles(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return {r["column"]: r for r in ro.column_roles(df).collect()}, df


def test_key_thresholds(spark):
    # 100 rows: a has 96 distinct (0.96 > 0.95) -> key; b has 95 distinct -> not;
    # b_id has 91 distinct and an id-like name -> key; c has 91 distinct, no id name -> not
    rows = [(i if i < 96 else 0, i if i < 95 else 0, i if i < 91 else 0, i if i < 91 else 0) for i in range(100)]
    r, _ = _roles(spark, rows, "a long, b long, b_id long, c long")
    assert r["a"]["is_key"] and not r["b"]["is_key"]
    assert r["b_id"]["is_key"] and not r["c"]["is_key"]


def test_key_null_ratio(spark):
    # 96 distinct non-null but 5 % nulls -> not a key; 4 % nulls -> key
    rows = [(i if i < 95 else None, i if i < 96 else None) for i in range(100)]
    r, _ = _roles(spark, rows, "a long, b long")
    assert not r["a"]["is_key"]
    assert r["b"]["is_key"]


def test_numeric_and_categorical_boundaries(spark):
    # 200 rows: n10 has 10 distinct (ratio .05) -> not numeric, categorical;
    # n11 has 11 distinct -> numeric; c20 / c21 as strings: 20 vs 21 distinct, both categorical (strings)
    rows = [(i % 10, i % 11, f"v{i % 20}", f"v{i % 21}") for i in range(200)]
    r, _ = _roles(spark, rows, "n10 long, n11 long, c20 string, c21 string")
    assert not r["n10"]["is_numeric"] and r["n10"]["is_categorical"]
    assert r["n11"]["is_numeric"]
    assert r["c20"]["is_categorical"] and r["c21"]["is_categorical"]
    # numeric with 21 distinct is not categorical
    rows = [(i % 21,) for i in range(400)]
    r, _ = _roles(spark, rows, "n21 long")
    assert not r["n21"]["is_categorical"]


def test_numeric_text_column(spark):
    rows = [(str(i * 1.5) if i % 4 else "n/a",) for i in range(100)]
    r, _ = _roles(spark, rows, "v string")
    assert r["v"]["castable"] == 75 and r["v"]["is_numeric"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "x double")
    m = st.missing_profile(df).collect()[0]
    assert m["missing_count"] == 2 and m["missing_percent"] == 50.0


def test_boolean_words(spark):
    df = spark.createDataFrame([(" Yes", "yes", "true"), ("no ", "yes", "FALSE"), (None, "yes", "true")],
                               "a string, b string, c string")
    out = cl.parse_boolean_words(df).collect()
    assert [r["a"] for r in out] == [1, 0, None]
    assert [r["b"] for r in out] == ["yes"] * 3  # a one-word column stays
    assert [r["c"] for r in out] == [1, 0, 1]


def test_date_threshold(spark):
    good = [("2020-01-%02d" % (i % 28 + 1),) for i in range(81)] + [("junk",)] * 19   # 81 % parse
    bad = [("2020-01-%02d" % (i % 28 + 1),) for i in range(80)] + [("junk",)] * 20    # 80 % parse
    d1 = cl.parse_datetime_columns(spark.createDataFrame(good, "d string"))
    d2 = cl.parse_datetime_columns(spark.createDataFrame(bad, "d string"))
    assert d1.schema["d"].dataType.typeName().startswith("timestamp")
    assert d2.schema["d"].dataType.typeName() == "string"


def test_empty_row_quirk(spark):
    df = spark.createDataFrame([(None, None), ("", " "), (None, ""), ("a", None)], "a string, b string")
    assert cl.drop_empty_rows(df).count() == 2          # mixed null / blank is kept
    assert cl.drop_empty_rows(df, strict=True).count() == 1


def test_name_normalisation():
    assert cl.normalized_names([" Event ID", "user-id", "Value ", "value"]) == \
        ["event_id", "user_id", "value", "value_1"]


def test_shape_stats_small_n(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    r = {x["column"]: x for x in st.shape_stats(df, ["x", "c"]).collect()}
    assert r["x"]["kurtosis"] is None              # n < 4
    assert r["c"]["skewness"] == 0.0               # constant column
    # bias-corrected skewness of 1, 2, 4 equals pandas' value
    assert math.isclose(r["x"]["skewness"], 0.9352195295828237, rel_tol=1e-9)


def test_moving_average_widths(spark):
    from sparkeda.operators import timeseries as ts
    import pandas as pd
    for n in (10, 20, 21):
        pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=n, freq="D"),
                            "v": [float(i * i % 7) for i in range(n)], "k": range(n)})
        df = spark.createDataFrame(pdf)
        got = ts.centered_moving_average(df, "t", "v", "k").orderBy("idx").select("trend").collect()
        w = min(7, n // 3)
        exp = pdf["v"].rolling(window=w, center=True).mean().tolist()
        for g, e in zip([r[0] for r in got], exp):
            assert (g is None and math.isnan(e)) or math.isclose(g, e, rel_tol=1e-9)



def test_moving_average_per_series(spark):
    # several series (one hot, one too short for a trend), each with its own width
    from sparkeda.operators import timeseries as ts
    import pandas as pd
    parts = []
    for sid, n in (("hot", 300), ("a", 10), ("b", 21), ("short", 7)):
        parts.append(pd.DataFrame({"s": sid, "t": pd.date_range("2024-01-01", periods=n, freq="D"),
                                   "v": [float((i * 7 + len(sid)) % 11) for i in range(n)],
                                   "k": [f"{sid}{i:04d}" for i in range(n)]}))
    pdf = pd.concat(parts, ignore_index=True)
    got = {(r["s"], r["key"]): r["trend"] for r in
           ts.centered_moving_average(spark.createDataFrame(pdf), "t", "v", "k", partition_by=["s"]).collect()}
    assert len(got) == len(pdf)
    for sid, g in pdf.groupby("s"):
        n = len(g)
        exp = [float("nan")] * n if n <= 7 else g["v"].rolling(window=min(7, n // 3), center=True).mean().tolist()
        for k, e in zip(g["k"], exp):
            v = got[(sid, k)]
            assert (v is None and math.isnan(e)) or math.isclose(v, e, rel_tol=1e-9), (sid, k)

def test_value_counts_nodata_and_nan_text(spark):
    df = spark.createDataFrame([("a",), (None,), (" NaN ",), ("a",)], "x string")
    r = {x["value"]: x["count"] for x in st.value_counts(df, ["x"]).collect()}
    assert r == {"a": 2, "NoData": 1}


def test_imbalance_one_class(spark):
    df = spark.createDataFrame([("a",), ("a",)], "x string")
    r = st.imbalance_summary(df, "x").collect()[0]
    assert r["minority_share"] == 0.0 and math.isinf(r["imbalance_ratio"])


def test_filter_pushdown(spark, sf):
    from sparkeda.operators import explore as ex
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = ex.apply_filters(li.select("l_orderkey", "l_returnflag"), {"l_returnflag": ["R"]}) \
        ._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1].split("]")[0]
    assert "l_returnflag" in pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
    _ = F
