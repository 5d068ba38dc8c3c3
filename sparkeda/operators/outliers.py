"""Outliers (O1-O4) and box summaries (D5), all read off ``NumericFacts``: one aggregate of
moments, one search for the quartiles of all columns, one count outside the fences. ``facts``
shares these between analyses of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..plans.quantiles import NumericFacts

_SUMMARY = ("column string, total_values long, iqr_outliers long, iqr_percent double, "
            "zscore_outliers long, zscore_percent double, mean double, std double, q1 double, q3 double, "
            "iqr double, lower_bound double, upper_bound double, min double, max double")
_BOX = ("column string, min double, q1 double, median double, q3 double, max double, mean double, std double, "
        "lower_fence double, upper_fence double, whisker_low double, whisker_high double")


def outlier_summary(df: DataFrame, cols: list[str], z: float = 3.0, min_values: int = 4,
                    max_cols: int | None = None, method: str = "exact", facts: NumericFacts | None = None) -> DataFrame:
    """O1 + O2 + O3: for the columns (or the first ``max_cols``) with >= ``min_values``
    values: IQR outliers (strictly outside Q1 - 1.5 IQR, Q3 + 1.5 IQR) and
    z-score outliers (|z| > 3; none when std = 0), counts and percents (2 dp)."""
    cols = cols[:max_cols]
    facts = facts or NumericFacts(df, cols, method)
    keep = [c for c in cols if facts.moments[c]["n"] >= max(1, min_values)]
    out = facts.outside(z) if keep else {}
    rows = []
    for c in keep:
        m, (q1, _, q3), (lower, upper) = facts.moments[c], facts.quartiles[c], facts.fences[c]
        rows.append((c, m["n"], out[c]["iqr"], out[c]["iqr"] * 100.0 / m["n"], out[c]["zscore"], out[c]["zscore"] * 100.0 / m["n"],
                     m["mean"], m["std"], q1, q3, q3 - q1, lower, upper, m["min"], m["max"]))
    found = df.sparkSession.createDataFrame(rows, _SUMMARY)
    return found.withColumn("iqr_percent", rnd(F.col("iqr_percent"), 2)).withColumn("zscore_percent", rnd(F.col("zscore_percent"), 2))


def iqr_outliers(df: DataFrame, cols: list[str], method: str = "exact", facts: NumericFacts | None = None) -> DataFrame:
    """O1: count, percent and fences per column."""
    return outlier_summary(df, cols, min_values=1, max_cols=None, method=method, facts=facts).select(
        "column", "total_values", "iqr_outliers", "iqr_percent", "lower_bound", "upper_bound")


def zscore_outliers(df: DataFrame, cols: list[str], z: float = 3.0, facts: NumericFacts | None = None) -> DataFrame:
    """O2: |x - mean| / sample std > z (no outliers when std is 0). One aggregate for the
    moments, one for the counts."""
    facts = facts or NumericFacts(df, cols, passes=2)
    out = facts.outside(z, by_quartiles=False)
    rows = [(c, m["n"], out[c]["zscore"], out[c]["zscore"] * 100.0 / m["n"], m["mean"], m["std"])
            for c in cols if (m := facts.moments[c])["n"]]
    found = df.sparkSession.createDataFrame(
        rows, "column string, total_values long, zscore_outliers long, zscore_percent double, mean double, std double")
    return found.withColumn("zscore_percent", rnd(F.col("zscore_percent"), 2))


def outlier_rows(df: DataFrame, col: str, k: int = 20, method: str = "iqr", z: float = 3.0) -> DataFrame:
    """Up to ``k`` outlying values, farthest from the bound first (then by
    value), so the pick is stable whatever the row order."""
    facts = NumericFacts(df, [col], passes=3)
    m, v = facts.moments[col], facts.values[col]
    none = df.sparkSession.createDataFrame([], "value double, distance double")
    if not m["n"] or (method != "iqr" and not m["std"]):
        return none
    if method == "iqr":
        lower, upper = facts.fences[col]
        cond, dist = (v < F.lit(lower)) | (v > F.lit(upper)), F.greatest(F.lit(lower) - v, v - F.lit(upper))
    else:
        dist = F.abs((v - F.lit(m["mean"])) / F.lit(m["std"]))
        cond = dist > z
    return (facts.base.filter(cond).select(v.alias("value"), dist.alias("distance"))
            .orderBy(F.desc("distance"), F.desc("value")).limit(k))


def box_summary(df: DataFrame, cols: list[str], method: str = "exact", facts: NumericFacts | None = None) -> DataFrame:
    """Five numbers, mean +/- sd, IQR fences and whisker ends (most extreme
    values inside the fences)."""
    facts = facts or NumericFacts(df, cols, method)
    live = [c for c in cols if facts.moments[c]["n"]]
    out = facts.outside() if live else {}
    rows = []
    for c in live:
        m = facts.moments[c]
        rows.append((c, m["min"], *facts.quartiles[c], m["max"], m["mean"], m["std"], *facts.fences[c], out[c]["low"], out[c]["high"]))
    return df.sparkSession.createDataFrame(rows, _BOX)
