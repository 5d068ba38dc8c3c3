"""Composed analyses (G9-G11, G16, G17, D9): they only wire operators together.

Each returns a dict of long-form DataFrames. Facts are computed once and handed
to every rule; per-entity de-duplication is an explicit argument (``entity`` +
``order``), done for all columns in one grouping.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import json_object, kind_of, local_frame, q, rnd
from ..operators import correlation as co
from ..operators import distribution as di
from ..operators import outliers as ou
from ..operators import stats as st
from ..session import cut_lineage
from .facts import column_facts, decisive_facts
from .quantiles import NumericFacts
from .roles import detect_candidate_targets, role_columns, select_visual_columns


def _roles(df, primary_keys=None, exact=True):
    """Facts and roles; ``exact=False`` counts distinct values only as far as rules need it."""
    facts = local_frame(column_facts(df)) if exact else decisive_facts(df)
    return facts, local_frame(role_columns(facts, primary_keys=primary_keys))


def dedup_by_entity(df: DataFrame, entity: str, order: str | None, cols: list[str]) -> DataFrame:
    """Last non-null value of each column per entity (G6 for many columns in one
    grouping); the entity column itself is kept. Without ``order`` the last row is the
    greatest one by all columns."""
    last = q(order) if order else F.struct(*[q(c) for c in df.columns])
    aggs = [F.max_by(q(c), F.when(q(c).isNotNull(), last)).alias(c) for c in cols if c != entity]
    return df.filter(q(entity).isNotNull()).groupBy(q(entity).alias(entity)).agg(*aggs)


def _per_entity(df: DataFrame, roles: list, entity: str | None, order: str | None, cols: list[str]) -> DataFrame:
    """One row per entity: the one named, else the first detected key (``""``: none). A key
    without repeats needs no grouping, only its rows without a key go."""
    if entity is None:
        entity = next((r["column"] for r in roles if r["is_key"]), "")
    if not entity:
        return df
    keys = column_facts(df.select(q(entity)))
    r = keys.collect()[0]
    if r["distinct_count"] == r["rows"] - r["nulls"]:
        return df.filter(q(entity).isNotNull()) if r["nulls"] else df
    return dedup_by_entity(df, entity, order, list(dict.fromkeys([*cols, entity])))


def profile(df: DataFrame, method: str = "exact", sections: list[str] | None = None) -> dict[str, DataFrame]:
    """Missing profile, numeric stats, outliers, histograms, value counts of text
    columns, datetime ranges, duplicates and the correlation matrix of numeric-typed
    columns; ``sections`` picks some of them."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    text = [c for c, k in kinds.items() if k == "string"]
    dates = [c for c, k in kinds.items() if k == "datetime"]
    make = {"missing": lambda: st.missing_profile(df), "duplicates": lambda: st.duplicate_summary(df)}
    if numeric:
        shared = cache(lambda: NumericFacts(df, numeric, method))
        make["numeric"] = lambda: st.numeric_stats(df, numeric, facts=shared())
        make["outliers"] = lambda: ou.iqr_outliers(df, numeric, facts=shared())
        make["histograms"] = lambda: di.histogram(df, numeric, facts=shared())
    if len(numeric) > 1:
        make["correlations"] = lambda: co.correlation_matrix(df, numeric)
    if text:
        make["value_counts"] = lambda: st.value_counts(df, text)
    if dates:
        make["datetime"] = lambda: st.datetime_profile(df, dates)
    return {name: fn() for name, fn in make.items() if sections is None or name in sections}


def profile_json(df: DataFrame, method: str = "exact", sections: list[str] | None = None) -> DataFrame:
    """G9 as one long table (section, payload) over all sections of ``profile``: a JSON
    object per row. Nulls are written; numbers that JSON lacks (NaN, infinities) are null."""
    parts = [frame.select(F.lit(name).alias("section"), json_object(frame).alias("payload"))
             for name, frame in profile(df, method, sections).items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def profile_long(df: DataFrame, method: str = "exact") -> DataFrame:
    """G9 in one long table (section, column, metric, value) for numeric facts."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    numeric = [c for c, k in kinds.items() if k == "numeric"]
    p = {"missing": st.missing_profile(df), "duplicates": st.duplicate_summary(df)}
    if numeric:
        p["numeric"] = st.numeric_stats(df, numeric, method=method)
    parts = [p["missing"].select(F.lit("missing").alias("section"), "column",
                                 F.explode(F.create_map(F.lit("missing_count"), F.col("missing_count").cast("double"),
                                                        F.lit("missing_percent"), F.col("missing_percent")))
                                 .alias("metric", "value"))]
    if "numeric" in p:
        mets = ["count", "missing", "mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]
        parts.append(p["numeric"].select(
            F.lit("numeric").alias("section"), "column",
            F.explode(F.create_map(*[x for m in mets for x in (F.lit(m), F.col(m).cast("double"))]))
            .alias("metric", "value")))
    dup = p["duplicates"].select(F.lit("duplicates").alias("section"), F.lit("*").alias("column"),
                                 F.explode(F.create_map(F.lit("duplicate_rows"), F.col("duplicate_rows").cast("double"),
                                                        F.lit("duplicate_percent"), F.col("duplicate_percent")))
                                 .alias("metric", "value"))
    parts.append(dup)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def profile_summary(df: DataFrame, primary_keys: list[str] | None = None,
                    sample: DataFrame | None = None, top_missing: int | None = None,
                    per_group: int | None = None, n_candidates: int | None = None,
                    n_imbalance: int | None = None) -> dict[str, DataFrame]:
    """Rows, columns, sample ratio (4 dp), keys, columns by share missing, column
    groups, candidate targets and their imbalance; the last four arguments keep only the
    first so many. Without ``sample`` the full data is the sample (ratio 1)."""
    sample = sample if sample is not None else df
    facts, roles = _roles(sample, primary_keys)
    keys = [r["column"] for r in roles.filter("is_key").orderBy("position").collect()] \
        if primary_keys is None else list(primary_keys)
    n_rows = df.count()
    n_sample = sample.count() if sample is not df else n_rows
    spark = df.sparkSession
    head = spark.createDataFrame([(n_rows, len(df.columns), n_sample, ", ".join(keys))],
                                 "rows long, columns long, sampled_rows long, primary_keys string")
    head = head.withColumn("sample_ratio", rnd(F.col("sampled_rows") / F.greatest(F.lit(1), F.col("rows")), 4))
    missing = (st.missing_profile(sample).orderBy(F.desc("missing_percent"), "position")
               .select("column", "missing_percent"))
    if top_missing is not None:
        missing = missing.limit(top_missing)
    from .roles import column_groups
    groups = column_groups(sample, facts, primary_keys=keys, per_group=per_group)
    cands = detect_candidate_targets(sample, facts, primary_keys=keys).orderBy("position")
    if n_candidates is not None:
        cands = cands.limit(n_candidates)
    imb = None
    for c in [r["column"] for r in cands.collect()][:n_imbalance]:
        x = st.imbalance_summary(sample, c)
        imb = x if imb is None else imb.unionByName(x)
    out = {"summary": head, "top_missing": missing, "groups": groups, "candidates": cands}
    if imb is not None:
        out["imbalance"] = imb
    return out


def column_details(df: DataFrame, col: str, primary_keys: list[str] | None = None,
                   method: str = "exact", top: int | None = 50, max_values: int | None = 100) -> dict[str, DataFrame]:
    """Counts, null % (2 dp), distinct, roles; numeric statistics when
    numeric; the ``top`` values (nulls excluded; None: all) with % of all rows when categorical
    or at most ``max_values`` distinct values (None: always)."""
    facts, roles = _roles(df.select(q(col)), primary_keys)
    r = roles.collect()[0]
    info = roles.select(F.col("column").alias("name"), F.col("rows").alias("total_count"),
                        F.col("nulls").alias("null_count"),
                        rnd(F.when(F.col("rows") > 0, F.col("nulls") * 100.0 / F.col("rows")), 2).alias("null_percentage"),
                        F.col("distinct_count").alias("unique_count"), "is_numeric", "is_categorical",
                        F.col("is_key").alias("is_primary_key"))
    out = {"info": info}
    if r["is_numeric"]:
        out["statistics"] = st.numeric_stats(df, [col], method=method).select(
            "mean", "median", "std", "min", "max", "q25", "q75")
    if r["is_categorical"] or max_values is None or r["distinct_count"] <= max_values:
        vc = st.value_counts(df, [col], top=top, drop_nan_text=False, include_null=False)
        out["top_values"] = vc.select("value", "count", "rank",
                                      rnd(F.col("count") * 100.0 / F.lit(max(1, r["rows"])), 2).alias("percentage"))
    return out


def numerical_analysis(df: DataFrame, entity: str | None = None, order: str | None = None,
                       primary_keys: list[str] | None = None, k: int | None = 30,
                       method: str = "exact") -> dict[str, DataFrame]:
    """Numeric -> sensible -> top-k visual columns (``k`` None: all) -> one row per entity
    (by T3 when none is named; ``entity=""``: all rows) -> statistics, IQR/z outliers,
    distribution bars/bins and box summaries; plus the numeric columns skipped as identifiers.
    All parts read one ``NumericFacts``, so the number of scans does not grow with the columns."""
    facts, roles = _roles(df, primary_keys, exact=False)
    rows = roles.orderBy("position").collect()
    numeric = [r["column"] for r in rows if r["is_numeric"]]
    sensible = [r["column"] for r in rows if r["is_numeric"] and r["is_sensible"]]
    skipped = [c for c in numeric if c not in sensible]
    vis = select_visual_columns(df, k, facts, primary_keys=primary_keys)
    chosen = {r["column"] for r in vis.filter("role = 'numeric'").collect()}
    cols = [c for c in sensible if c in chosen][:k]
    out = {"skipped": df.sparkSession.createDataFrame([(c,) for c in skipped], "column string")}
    if not cols:
        return out
    shared = NumericFacts(_per_entity(df, rows, entity, order, cols), cols, method, passes=6)
    out["statistics"] = st.numeric_stats(df, cols, facts=shared)
    out["outliers"] = ou.outlier_summary(df, cols, max_cols=None, min_values=1, facts=shared)
    out["distribution"] = di.distribution_histogram(df, cols, facts=shared)
    out["box"] = ou.box_summary(df, cols, facts=shared)
    return out


def categorical_analysis(df: DataFrame, entity: str | None = None, order: str | None = None,
                         primary_keys: list[str] | None = None, k: int | None = 30, bars: int | None = 30,
                         max_shares: int | None = 15) -> dict[str, DataFrame]:
    """Categorical -> top-k visual columns (``k`` None: all) -> one row per entity (as in
    G16) -> bars (top ``bars`` + No Value) and shares, both from one count of all values of
    all columns; plus identifiers skipped with uniqueness."""
    from .roles import skipped_columns
    facts, roles = _roles(df, primary_keys, exact=False)
    rows = roles.orderBy("position").collect()
    if k is not None and sum(r["is_categorical"] for r in rows) > k:
        facts = local_frame(column_facts(df))                     # which k are best hangs on exact counts
    vis = select_visual_columns(df, k, facts, primary_keys=primary_keys)
    cols = [r["column"] for r in vis.filter("role = 'categorical'").orderBy("rank").collect()]
    unlike = [r["column"] for r in rows if not r["is_categorical"] and r["is_unique"]]
    keys = [r["column"] for r in rows if r["is_key"]]
    # the uniqueness reported for skipped columns is exact: only theirs are counted again
    skip = [x.asDict() for x in column_facts(df, unlike).collect()] if unlike else []
    at = {r["column"]: r["position"] for r in rows}
    skip = df.sparkSession.createDataFrame([tuple({**x, "position": at[x["column"]]}.values()) for x in skip], column_facts(df, df.columns[:1]).schema)
    out = {"skipped": skipped_columns(df, skip, primary_keys=keys)}
    if not cols:
        return out
    out["bars"] = cut_lineage(di.bars_of_columns(_per_entity(df, rows, entity, order, cols), cols, bars))
    out["shares"] = di.shares_of_bars(out["bars"], max_shares)
    return out


def report_tables(df: DataFrame, n_numeric: int | None = None, n_categorical: int | None = None,
                  top: int | None = None) -> dict[str, DataFrame]:
    """Histograms of the numeric-typed columns, the ``top`` values of the text columns
    and the zero-filled correlation matrix; the first two arguments keep only the first
    so many columns."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    numeric = [c for c, kd in kinds.items() if kd == "numeric"]
    text = [c for c, kd in kinds.items() if kd == "string"][:n_categorical]
    out = {}
    if numeric:
        out["histograms"] = di.histogram(df, numeric[:n_numeric])
    if text:
        out["top_values"] = st.value_counts(df, text, top=top, drop_nan_text=False, include_null=False)
    if len(numeric) >= 2:
        out["correlation"] = co.correlation_matrix(df, numeric).withColumn(
            "corr", F.coalesce("corr", F.lit(0.0)))
    return out
