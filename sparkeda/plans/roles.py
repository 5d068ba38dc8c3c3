"""Column roles (key / numeric / sensible / categorical / group) as predicates over
``column_facts``. Every rule reads the one fact row of its column, so role
inference costs one aggregate job however many rules are asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DATETIME_TYPES, kind_of, local_frame, numeric_value, q, rnd
from ..functions.values import DATE_FORMATS
from .facts import column_facts, decisive_facts, facts_rows


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def role_columns(facts: DataFrame, primary_keys: list[str] | None = None,
                 sensible_override: dict | None = None) -> DataFrame:
    """Add the role flags to a facts frame.

    ``primary_keys`` overrides key detection (the reference takes keys from the
    full data even when other rules look at a sample); ``sensible_override``
    maps column -> bool and replaces the reference's model vote on numeric columns.
    """
    ratio = _ratio(F.col("distinct_count"), F.col("rows"))
    null_ratio = _ratio(F.col("nulls"), F.col("rows"))
    f = facts.withColumn("unique_ratio", ratio).withColumn("null_ratio", null_ratio)
    if primary_keys is None:
        key = (((F.col("unique_ratio") > 0.95) & (F.col("null_ratio") < 0.05))
               | ((F.col("unique_ratio") > 0.90) & F.col("key_name") & (F.col("null_ratio") < 0.05)))
    else:
        key = F.col("column").isin(list(primary_keys)) if primary_keys else F.lit(False)
    f = f.withColumn("is_key", key)
    kind = F.col("kind")
    numeric = (F.when(kind == "numeric", (F.col("distinct_count") > 10) | (F.col("unique_ratio") > 0.1))
               .when(kind == "string",
                     (F.col("castable") > F.col("rows") * 0.5)
                     & ((F.col("castable_distinct") > 10)
                        | (_ratio(F.col("castable_distinct"), F.col("castable")) > 0.1)))
               .otherwise(F.lit(False)))
    f = f.withColumn("is_numeric", numeric)
    phone = (F.col("phone_name") & (F.col("num_min") >= 1e9) & (F.col("num_max") < 1e15)
             & (F.col("unique_ratio") > 0.8))
    sensible = ~F.col("is_key") & ~(F.col("sensible_id_name") & (F.col("unique_ratio") > 0.95)) \
        & ~F.coalesce(phone, F.lit(False))
    if sensible_override:
        for c, v in sensible_override.items():
            sensible = F.when(F.col("column") == c, F.lit(bool(v))).otherwise(sensible)
    f = f.withColumn("is_sensible", sensible)
    categorical = (F.when(F.col("is_key") | (F.col("unique_ratio") > 0.95), F.lit(False))
                   .when(kind == "string",
                         ~(F.col("email_name") & (F.col("unique_ratio") > 0.8))
                         & ~(F.col("ident_name") & (F.col("unique_ratio") > 0.9)))
                   .when(kind == "numeric", (F.col("distinct_count") <= 20) & (F.col("unique_ratio") < 0.1))
                   .when(kind == "boolean", F.lit(True))
                   .otherwise(F.lit(False)))
    f = f.withColumn("is_categorical", categorical)
    group = (F.when(F.col("is_key"), F.lit("identifiers"))
             .when(kind == "datetime", F.lit("datetime"))
             .when(F.col("is_numeric"), F.lit("numeric"))
             .when(F.col("is_categorical"), F.lit("categorical"))
             .when(F.coalesce(F.col("avg_len"), F.lit(0.0)) >= 20, F.lit("text"))
             .otherwise(F.lit("categorical")))
    f = f.withColumn("group_name", group)
    f = f.withColumn("is_unique", F.col("is_key") | (F.col("unique_ratio") > 0.95))
    return f


def column_roles(df: DataFrame, facts: DataFrame | None = None, **kw) -> DataFrame:
    """One row per column with every role flag."""
    facts = facts if facts is not None else column_facts(df)
    return role_columns(facts, **kw)


def column_role_flags(df: DataFrame, **kw) -> DataFrame:
    """T1-T7, T14 without counts: the flags of ``column_roles`` from ``decisive_facts``, which
    recounts exactly only the columns whose sketched counts leave a rule open."""
    return role_columns(decisive_facts(df), **kw).select(
        "position", "column", "kind", "is_key", "is_numeric", "is_sensible", "is_categorical", "group_name", "is_unique")


def detect_primary_keys(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Key columns (position, column, unique_ratio, null_ratio)."""
    return (column_roles(df, facts).filter("is_key")
            .select("position", "column", "unique_ratio", "null_ratio"))


def primary_key_list(df: DataFrame, facts: DataFrame | None = None) -> list[str]:
    return [r["column"] for r in detect_primary_keys(df, facts).orderBy("position").collect()]


def detect_entity_id(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The first detected key in column order (0 or 1 row)."""
    return detect_primary_keys(df, facts).orderBy("position").limit(1).select("column")


def column_groups(df: DataFrame, facts: DataFrame | None = None, primary_keys=None,
                  per_group: int | None = None) -> DataFrame:
    """(group_name, position, column); ``per_group`` keeps the first n of each group."""
    g = column_roles(df, facts, primary_keys=primary_keys).select("group_name", "position", "column")
    if per_group:
        w = Window.partitionBy("group_name").orderBy("position")
        g = g.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_group).drop("_r")
    return g


def _scores(df: DataFrame, roles: DataFrame, min_numeric: int, cat_range: tuple[int, int],
            exclude: list[str]) -> DataFrame:
    """Numeric score = variance x (1 - missing); categorical = (1 - missing) / max(1, ln(distinct+1))."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    roles = local_frame(roles)
    numeric = [r["column"] for r in roles.filter("is_numeric and not is_key").collect()
               if r["column"] not in exclude]
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            nv = numeric_value(c, fields[c])
            aggs += [F.count(nv).alias(f"n{i}"), F.var_samp(nv).alias(f"v{i}")]
        row = df.agg(*aggs)
        var_df = row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_values"),
                     F.col(f"v{i}").alias("variance")) for i, c in enumerate(numeric)])))
    else:
        var_df = df.sparkSession.createDataFrame([], "column string, n_values long, variance double")
    r = roles.join(F.broadcast(var_df), "column", "left")
    lo, hi = cat_range
    missing = F.col("null_ratio")
    num_score = F.coalesce(F.col("variance"), F.lit(0.0)) * (1 - missing)
    cat_score = (1 - missing) / F.greatest(F.lit(1.0), F.log(F.col("distinct_count") + 1))
    keep = ~F.col("is_key") & ~F.col("column").isin(exclude) if exclude else ~F.col("is_key")
    numeric_part = r.filter(keep & F.col("is_numeric") & (F.col("n_values") >= min_numeric)) \
        .select(F.lit("numeric").alias("role"), "position", "column", num_score.alias("score"))
    cat_part = r.filter(keep & ~F.col("is_numeric") & F.col("is_categorical")
                        & (F.col("distinct_count") >= lo) & (F.col("distinct_count") <= hi)) \
        .select(F.lit("categorical").alias("role"), "position", "column", cat_score.alias("score"))
    return numeric_part.unionByName(cat_part)


def select_visual_columns(df: DataFrame, k: int | None = 30, facts: DataFrame | None = None,
                          primary_keys=None) -> DataFrame:
    """Top ``k`` (None: all) numeric and categorical columns by score (rank 1 = best)."""
    roles = column_roles(df, facts, primary_keys=primary_keys)
    s = _scores(df, roles, 3, (2, 1 << 62), [])
    w = Window.partitionBy("role").orderBy(F.desc("score"), "position")
    ranked = s.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def select_prediction_features(df: DataFrame, target: str, facts: DataFrame | None = None,
                               max_features: int = 80, primary_keys=None) -> DataFrame:
    """Numeric (>= 10 values) and categorical (2-200 distinct) features, <= 40 each."""
    roles = column_roles(df, facts, primary_keys=primary_keys)
    s = _scores(df, roles, 10, (2, 200), [target])
    w = Window.partitionBy("role").orderBy(F.desc("score"), "position")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_features // 2)


def detect_candidate_targets(df: DataFrame, facts: DataFrame | None = None, primary_keys=None) -> DataFrame:
    """Categorical columns with 2-20 distinct values."""
    return (column_roles(df, facts, primary_keys=primary_keys)
            .filter("not is_key and is_categorical and distinct_count between 2 and 20")
            .select("position", "column", "distinct_count"))


def auto_select_target(df: DataFrame, facts: DataFrame | None = None, primary_keys=None) -> DataFrame:
    """The candidate target with the highest (1 - majority share) + distinct / 20, the
    earlier column on ties; no row when no column qualifies. One pass over the candidates."""
    found = [(r["position"], r["column"]) for r in
             detect_candidate_targets(df, facts, primary_keys).orderBy("position").collect()]
    spark = df.sparkSession
    if not found:
        return spark.createDataFrame([], "column string, score double")
    cells = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(c).alias("column"), q(c).cast("string").alias("v"))
                      for p, c in found])
    counts = df.select(F.inline(cells)).filter("v is not null").groupBy("pos", "column", "v").agg(F.count(F.lit(1)).alias("n"))
    scored = counts.groupBy("pos", "column").agg(
        (1.0 - rnd(F.max("n") / F.sum("n"), 3) + F.count(F.lit(1)) / 20.0).alias("score"))
    return scored.orderBy(F.desc("score"), "pos").limit(1).select("column", "score")


def detect_task_type(df: DataFrame, target: str, facts: DataFrame | None = None) -> DataFrame:
    """Regression for a float target with > 20 values, or a numeric one with
    > 30 values and ratio > 0.1; classification otherwise."""
    dt = df.schema[target].dataType
    facts = facts if facts is not None else column_facts(df, [target])
    fr = facts.filter(F.col("column") == target)
    is_float = dt.typeName() in ("float", "double")
    is_num = kind_of(dt) in ("numeric", "boolean")
    d, n = F.col("distinct_count"), F.col("rows")
    reg = F.lit(False)
    if is_float:
        reg = reg | (d > 20)
    if is_num:
        reg = reg | ((d > 30) & (_ratio(d, n) > 0.1))
    return fr.select("column", F.when(reg, "regression").otherwise("classification").alias("task"))


def detect_datetime_columns(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Non-numeric columns whose every non-null value is a date (any format of
    the list, per value) and that are non-null in more than 80 % of rows. Texts are parsed once
    for each distinct value, with the patterns its shape allows."""
    from ..operators.clean import with_dates
    fields = {f.name: f.dataType for f in df.schema.fields}
    cand = [c for c, t in fields.items() if kind_of(t) in ("string", "datetime")]
    if not cand:
        return df.sparkSession.createDataFrame([], "position int, column string")
    cells = []
    for i, c in enumerate(cand):
        native = isinstance(fields[c], DATETIME_TYPES)
        cells.append(F.struct(F.lit(i).alias("i"), F.when(q(c).isNotNull(), F.lit("")).alias("v") if native else q(c).alias("v")))
    counts = df.select(F.inline(F.array(*cells))).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    native = F.col("i").isin([i for i, c in enumerate(cand) if isinstance(fields[c], DATETIME_TYPES)] or [-1])
    y0, y1 = F.array_min(F.transform("dates", lambda d: d["y"])), F.array_max(F.transform("dates", lambda d: d["y"]))
    there = F.col("v").isNotNull()
    per = with_dates(counts, formats or DATE_FORMATS).groupBy("i").agg(
        F.sum("n").alias("rows"), F.sum(F.when(there, F.col("n"))).alias("non_null"),
        F.sum(F.when(there & (native | (F.size("dates") > 0)), F.col("n"))).alias("parsed"), F.min(y0).alias("y0"), F.max(y1).alias("y1"))
    ok = (F.col("parsed") == F.col("non_null")) & (F.col("parsed") > F.col("rows") * 0.8) \
        & (native | ((F.col("y0") >= 1900) & (F.col("y1") <= 2100)))
    pos = {c: i for i, c in enumerate(fields)}
    names = F.array(*[F.struct(F.lit(pos[c]).alias("position"), F.lit(c).alias("column")) for c in cand])
    return per.filter(ok).select(F.get(names, F.col("i")).alias("c")).select("c.position", "c.column")


def skipped_columns(df: DataFrame, facts: DataFrame | None = None, primary_keys=None) -> DataFrame:
    """Columns left out of categorical analysis, with uniqueness % and reason."""
    r = column_roles(df, facts, primary_keys=primary_keys)
    return (r.filter(~F.col("is_categorical") & (F.col("is_key") | (F.col("unique_ratio") > 0.95)))
            .select("position", "column",
                    rnd(F.col("unique_ratio") * 100, 2).alias("uniqueness"),
                    F.when(F.col("is_key"), F.lit("Detected primary key"))
                    .otherwise(F.lit("High uniqueness - likely identifier/primary key")).alias("reason")))


def roles_dict(df: DataFrame, facts: DataFrame | None = None, **kw) -> list[dict]:
    """Collected role rows (one per column) for building data-dependent plans."""
    return facts_rows(column_roles(df, facts, **kw))
