"""Profile statistics (G1-G8, K7): one aggregate per question, long-form results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (bias_corrected_kurt, bias_corrected_skew, clean_value, kind_of, strip,
                               numeric_value, q, rnd)
from ..functions.values import NODATA
from ..plans.quantiles import NumericFacts


def _fields(df):
    return {f.name: f.dataType for f in df.schema.fields}


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """G1: (position, column, missing_count, missing_percent 2 dp) in one aggregate."""
    fields = _fields(df)
    cols = cols or list(fields)
    row = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(clean_value(c, fields[c])).alias(f"c{i}") for i, c in enumerate(cols)])
    out = row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 (F.col("__n") - F.col(f"c{i}")).cast("long").alias("missing_count"),
                 F.col("__n").cast("long").alias("rows"))
        for i, c in enumerate(cols)])))
    pct = F.when(F.col("rows") > 0, F.col("missing_count") * 100.0 / F.col("rows")).otherwise(0.0)
    return out.select("position", "column", "missing_count", rnd(pct, 2).alias("missing_percent"))


def high_missing_report(df: DataFrame, pct: float = 50.0) -> DataFrame:
    """K7: columns with more than ``pct`` % missing (reported, never dropped)."""
    return missing_profile(df).filter(F.col("missing_percent") > pct)


def _numeric_exprs(df, cols):
    fields = _fields(df)
    return {c: numeric_value(c, fields[c]) for c in cols}


def column_moments(df: DataFrame, vals: dict) -> DataFrame:
    """Per value expression: rows, count, mean, sample std, min, max and the
    population skewness / excess kurtosis, in long form: one narrow unpivot and
    one grouped aggregate with a fixed set of functions, so the generated code
    (and whole-stage codegen) does not depend on how many columns are asked."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                                 v.alias("v")) for i, (c, v) in enumerate(vals.items())])))
    return long.groupBy("position", "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))


def numeric_stats(df: DataFrame, cols: list[str], method: str = "exact", facts: NumericFacts | None = None) -> DataFrame:
    """G2 + G3: count, missing, mean, median, sample std, min, max, q25, q75,
    bias-corrected skewness and excess kurtosis, per column.

    Moments are one grouped aggregate; quartiles come from ``exact_quantiles`` (distributed
    selection) or ``percentile_approx`` when ``method='approx'``. ``facts`` hands over
    what another analysis of the same columns already has."""
    facts = facts or NumericFacts(df, cols, method)
    rows = []
    for i, c in enumerate(cols):
        m, (q25, median, q75) = facts.moments[c], facts.quartiles[c]
        rows.append((i, c, m["n"], m["rows"] - m["n"], m["mean"], median, m["std"], m["min"], m["max"], q25, q75, m["g1"], m["g2"]))
    found = df.sparkSession.createDataFrame(
        rows, "position int, column string, count long, missing long, mean double, median double, std double, "
              "min double, max double, q25 double, q75 double, g1 double, g2 double")
    n = F.col("count").cast("double")
    return found.select("position", "column", "count", "missing", "mean", "median", "std", "min", "max", "q25", "q75",
                        bias_corrected_skew(F.col("g1"), n).alias("skewness"), bias_corrected_kurt(F.col("g2"), n).alias("kurtosis"))


def shape_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis only (one aggregate)."""
    vals = _numeric_exprs(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        v = vals[c]
        aggs += [F.count(v).alias(f"n{i}"), F.skewness(v).alias(f"g1{i}"), F.kurtosis(v).alias(f"g2{i}")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 bias_corrected_skew(F.col(f"g1{i}"), F.col(f"n{i}").cast("double")).alias("skewness"),
                 bias_corrected_kurt(F.col(f"g2{i}"), F.col(f"n{i}").cast("double")).alias("kurtosis"))
        for i, c in enumerate(cols)])))


def value_counts(df: DataFrame, cols: list[str], top: int | None = None,
                 nodata: str = NODATA, drop_nan_text: bool = True,
                 include_null: bool = True) -> DataFrame:
    """(column, value, count, rank) with NULL as ``NoData``; the text ``nan``
    (any case, trimmed) is dropped. Rank is by count desc, then value.

    The unpivot is a narrow explode; ``groupBy(column, value)`` aggregates
    map-side first, so a value holding a third of the rows costs one row per task.
    """
    fields = _fields(df)
    structs = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                        clean_value(c, fields[c]).cast("string").alias("value"))
               for i, c in enumerate(cols)]
    long = df.select(F.inline(F.array(*structs)))
    if drop_nan_text:
        long = long.filter(F.col("value").isNull() | (F.lower(strip(F.col("value"))) != "nan"))
    if not include_null:
        long = long.filter(F.col("value").isNotNull())
    counts = (long.groupBy("position", "column", F.coalesce("value", F.lit(nodata)).alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    # ranks per column without one task per column: salted top-k, or a global numbering
    from ..plans.ranking import rank_in_groups
    return rank_in_groups(counts, ["column"], [F.desc("count"), F.col("value")], "rank", top)


def datetime_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min, max and number of distinct months per datetime column."""
    fields = _fields(df)
    aggs = []
    for i, c in enumerate(cols):
        v = q(c) if kind_of(fields[c]) == "datetime" else F.to_timestamp(q(c))
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"),
                 F.count_distinct(F.date_trunc("month", v)).alias(f"m{i}")]
    row = df.agg(*aggs)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.date_format(f"a{i}", fmt).alias("min_date"),
                 F.date_format(f"b{i}", fmt).alias("max_date"), F.col(f"m{i}").cast("long").alias("months"))
        for i, c in enumerate(cols)])))


def monthly_counts(df: DataFrame, col: str, max_months: int | None = None) -> DataFrame:
    """Records per month ('yyyy-MM'); with ``max_months`` the result is
    empty when the column spans more months."""
    m = (df.filter(q(col).isNotNull())
         .groupBy(F.date_format(F.date_trunc("month", q(col)), "yyyy-MM").alias("month"))
         .agg(F.count(F.lit(1)).alias("count")))
    if max_months is not None:
        m = (m.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))
             .filter(F.col("_m") <= max_months).drop("_m"))
    return m


def last_per_entity(df: DataFrame, entity: str, col: str, order: str) -> DataFrame:
    """Per entity, the value of ``col`` at the greatest ``order`` among rows
    where ``col`` is not null; entities with only nulls keep NULL; null entities
    vanish. One aggregate with map-side combine (hot entities are cheap)."""
    v = q(col)
    return (df.filter(q(entity).isNotNull())
            .groupBy(q(entity).alias(entity))
            .agg(F.max_by(v, F.when(v.isNotNull(), q(order))).alias(col)))


def imbalance_summary(df: DataFrame, col: str) -> DataFrame:
    """Total, classes, majority/minority share (3 dp) and max/min ratio (3 dp;
    minority 0 and ratio infinite for one class)."""
    counts = df.filter(q(col).isNotNull()).groupBy(q(col).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    s = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"),
                   F.max("n").alias("mx"), F.min("n").alias("mn"))
    return s.select(
        F.lit(col).alias("column"), F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.col("classes").cast("long").alias("classes"),
        rnd(F.col("mx") / F.col("total"), 3).alias("majority_share"),
        F.when(F.col("classes") == 1, F.lit(0.0)).otherwise(rnd(F.col("mn") / F.col("total"), 3)).alias("minority_share"),
        F.when(F.col("classes") == 1, F.lit(float("inf"))).otherwise(
            rnd(F.col("mx") / F.greatest(F.lit(1), F.col("mn")), 3)).alias("imbalance_ratio"))


def top_classes(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """G7 companion: the ``k`` most frequent classes (ties by value)."""
    return (value_counts(df, [col], top=k, include_null=False, drop_nan_text=False)
            .select("value", "count", "rank"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Full-row duplicates beyond the first (null equals null): one grouping
    shuffle, duplicates pre-aggregated map-side."""
    g = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    s = g.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))
    dup = F.coalesce(F.col("rows"), F.lit(0)) - F.col("distinct_rows")
    return s.select(F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows"),
                    F.col("distinct_rows").cast("long").alias("distinct_rows"),
                    dup.cast("long").alias("duplicate_rows"),
                    F.when(F.col("rows") > 0, rnd(dup * 100.0 / F.col("rows"), 2))
                    .otherwise(F.lit(0.0)).alias("duplicate_percent"))


def group_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, list[str]]) -> DataFrame:
    """Group by ``keys`` with named aggregates, e.g. {'salary': ['mean', 'max']}.

    Only aggregates that combine map-side are offered: an exact grouped median
    would gather a hot group into one task."""
    fn = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max,
          "count": F.count, "std": F.stddev_samp, "nunique": F.count_distinct}
    exprs = [fn[a](q(c)).alias(f"{a}_{c}") for c, lst in aggs.items() for a in lst]
    return df.groupBy(*[q(k) for k in keys]).agg(*exprs)


def scalar_result(df: DataFrame, expr) -> DataFrame:
    """A scalar answer as a one-row table with column ``result``."""
    e = F.expr(expr) if isinstance(expr, str) else expr
    return df.agg(e.alias("result"))
