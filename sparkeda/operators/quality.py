"""Data health score (G12) and rule-based insights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean_value, numeric_value, q, rnd
from ..plans.facts import column_facts
from ..plans.roles import role_columns
from ..session import spread


def health_score(df: DataFrame, primary_keys: list[str] | None = None) -> DataFrame:
    """Completeness x .40 + uniqueness x .25 + consistency x .20 + validity x .15
    (each 0-100, 1 dp) and a grade (>= 90 Excellent, >= 75 Good, >= 60 Fair, else Poor).

    completeness = 1 - missing cells / cells; uniqueness = 1 - duplicate rows / rows;
    consistency = mean of 1 - min(1, |sample skew| / 10) over non-key numeric
    columns with more than 5 values (100 when there is none); validity = share of
    columns at most 50 % missing. Run it on raw data: after ``clean`` the
    duplicates are gone and uniqueness is always 100.
    Jobs: facts (roles), one moments aggregate, one duplicate grouping.
    """
    df = spread(df, passes=3)
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(fields)
    roles = role_columns(column_facts(df), primary_keys=primary_keys).select(
        "column", "is_key", "is_numeric").collect()
    numeric = [r["column"] for r in roles if r["is_numeric"] and not r["is_key"]]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(clean_value(c, fields[c])).alias(f"n{i}") for i, c in enumerate(cols)]
    for j, c in enumerate(numeric):
        v = numeric_value(c, fields[c])
        aggs += [F.count(v).alias(f"k{j}"), F.skewness(v).alias(f"g{j}")]
    row = df.agg(*aggs)
    distinct_rows = (df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
                     .agg(F.count(F.lit(1))).collect()[0][0])  # one number
    s = row.withColumn("distinct_rows", F.lit(distinct_rows).cast("long"))
    ncols = len(cols)
    cells = F.col("rows") * ncols
    missing = sum((F.col("rows") - F.col(f"n{i}") for i in range(ncols)), F.lit(0))
    completeness = F.greatest(F.lit(0.0), 1 - F.try_divide(missing, cells)) * 100
    uniqueness = F.greatest(F.lit(0.0), 1 - (F.col("rows") - F.col("distinct_rows"))
                            / F.greatest(F.lit(1), F.col("rows"))) * 100
    terms, flags = [], []
    for j, _ in enumerate(numeric):
        n = F.col(f"k{j}").cast("double")
        g1 = F.coalesce(F.col(f"g{j}"), F.lit(0.0))
        skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(F.lit(None))
        ok = (F.col(f"k{j}") > 5) & skew.isNotNull()
        terms.append(F.when(ok, 1 - F.least(F.lit(1.0), F.abs(skew) / 10)).otherwise(F.lit(0.0)))
        flags.append(F.when(ok, 1).otherwise(0))
    if terms:
        used = sum(flags, F.lit(0))
        consistency = F.when(used > 0, sum(terms, F.lit(0.0)) / used * 100).otherwise(F.lit(100.0))
    else:
        consistency = F.lit(100.0)
    high = sum((F.when((F.col("rows") > 0) & ((F.col("rows") - F.col(f"n{i}")) / F.col("rows") > 0.5), 1)
                .otherwise(0) for i in range(ncols)), F.lit(0))
    validity = F.greatest(F.lit(0.0), 1 - high / max(1, ncols)) * 100
    out = s.select(completeness.alias("completeness"), uniqueness.alias("uniqueness"),
                   consistency.alias("consistency"), validity.alias("validity"))
    overall = (F.col("completeness") * 0.40 + F.col("uniqueness") * 0.25 + F.col("consistency") * 0.20
               + F.col("validity") * 0.15)
    out = out.withColumn("overall", overall)
    grade = (F.when(F.col("overall") >= 90, "Excellent").when(F.col("overall") >= 75, "Good")
             .when(F.col("overall") >= 60, "Fair").otherwise("Poor"))
    return out.select(*[rnd(F.col(c), 1).alias(c) for c in
                        ["completeness", "uniqueness", "consistency", "validity", "overall"]],
                      grade.alias("grade"))


def basic_insights(df: DataFrame) -> DataFrame:
    """Rule sentences, one row each (line, text): shape (thousands
    separators), numeric column count, text column count, and columns with
    more than 10 % missing."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(fields)
    numeric = [c for c, t in fields.items() if t.typeName() in
               ("byte", "short", "integer", "long", "float", "double", "boolean") or t.typeName().startswith("decimal")]
    text = [c for c, t in fields.items() if t.typeName() == "string"]
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(clean_value(c, fields[c])).alias(f"n{i}") for i, c in enumerate(cols)])
    lines = [F.format_string("Dataset contains %s rows and %d columns",
                             F.format_number(F.col("rows"), 0), F.lit(len(cols)))]
    if numeric:
        lines.append(F.lit(f"Found {len(numeric)} numeric columns for quantitative analysis"))
    if text:
        lines.append(F.lit(f"Found {len(text)} categorical columns for classification"))
    high = [F.when((F.col("rows") > 0) & ((F.col("rows") - F.col(f"n{i}")) * 100.0 / F.col("rows") > 10),
                   F.lit(c)) for i, c in enumerate(cols)]
    names = F.concat_ws(", ", *high)
    lines.append(F.when(names != "", F.concat(F.lit("Columns with significant missing data: "), names)))
    out = row.select(F.posexplode(F.array(*lines)).alias("line", "text"))
    return out.filter(F.col("text").isNotNull())
