"""Roles from sketched counts with a recount of borderline columns equal those from exact counts."""

import pytest
from pyspark.sql import functions as F

from sparkeda.plans import facts as fx
from sparkeda.plans import roles as ro

N = 20_000
FLAGS = ["is_key", "is_numeric", "is_sensible", "is_categorical", "group_name", "is_unique"]


def _planted(spark):
    """Columns on both sides of every limit, and columns far from all of them."""
    i = F.col("id")
    cols = [F.when(i % N < round(r * N), i).otherwise(0).alias(f"d_{str(r).replace('.', '_')}_{j}")
            for j, r in enumerate((0.0999, 0.1, 0.1001, 0.8, 0.8001, 0.9, 0.9001, 0.95, 0.9501))]
    cols += [(i % k).alias(f"k{k}") for k in (1, 2, 9, 10, 11, 12, 20, 21, 30, 31, 50, 51, 60, 61, 100, 101, 200, 201)]
    cols += [F.when(i % N < round(r * N), F.concat(F.lit("v"), i)).otherwise("v").alias(f"s_{j}_email") for j, r in enumerate((0.8, 0.81, 0.95, 0.951))]
    cols += [F.when(i % 2 == 0, (i % k).cast("string")).otherwise("x").alias(f"half{k}") for k in (10, 11, 4000)]
    cols += [i.alias("far_unique"), F.concat(F.lit("t"), i % (N // 2)).alias("far_half"), (i % (N // 2) / 3).alias("far_half_number"),
             (F.lit(2 ** 60) + i).alias("wide_id"), F.lit(None).cast("string").alias("nothing"),
             F.when(i % 20 != 0, i).alias("null_five"), F.when(i % 21 != 0, i).alias("null_less")]
    return spark.range(N).repartition(5).select(*cols)


def test_roles_equal_the_exact_path(spark):
    df = _planted(spark)
    exact = {r["column"]: r.asDict() for r in ro.column_roles(df).collect()}
    got = {r["column"]: r.asDict() for r in ro.column_role_flags(df).collect()}
    assert set(got) == set(exact)
    for c, r in got.items():
        assert {f: r[f] for f in FLAGS} == {f: exact[c][f] for f in FLAGS}, c


def test_only_borderline_columns_are_counted_again(spark):
    df = _planted(spark)
    rows = {r["column"]: r for r in fx.facts_rows(fx.decisive_facts(df))}
    exact = {r["column"]: r for r in fx.facts_rows(fx.column_facts(df))}
    assert not any(rows[c]["counted"] for c in ("far_unique", "far_half", "far_half_number", "wide_id"))
    assert all(rows[c]["counted"] for c in ("k10", "k20", "k200", "d_0_1_1", "d_0_95_7", "s_2_email", "nothing"))
    for c, r in rows.items():
        if r["counted"]:
            assert {k: v for k, v in r.items() if k != "counted"} == exact[c]
        else:
            assert r["distinct_count"] == pytest.approx(exact[c]["distinct_count"], rel=0.025)


def test_numbers_and_texts_are_grouped_apart(spark):
    df = spark.createDataFrame([(2 ** 53 + i, float(i % 3), str(i % 4), i % 2 == 0) for i in range(50)] + [(None, float("nan"), None, None)],
                               "l long, d double, s string, b boolean").withColumn("m", F.col("l").cast("decimal(38,0)") * 10)
    f = {r["column"]: r for r in fx.facts_rows(fx.column_facts(df))}
    assert {c: f[c]["distinct_count"] for c in f} == {"l": 50, "d": 3, "s": 4, "b": 2, "m": 50}
    assert all(f[c]["nulls"] == 1 and f[c]["rows"] == 51 for c in f)
    assert f["s"]["castable_distinct"] == 4 and f["s"]["avg_len"] == 1.0
