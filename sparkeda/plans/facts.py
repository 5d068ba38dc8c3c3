"""One aggregate pass that every role rule and profile reads (``column_facts``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import clean_value, kind_of, numeric_value, q
from ..session import spread
from ..functions.values import (EMAIL_KEYWORDS, IDENTIFIER_KEYWORDS, KEY_NAME_PATTERNS,
                                PHONE_PATTERNS, SENSIBLE_ID_PATTERNS, name_has)

FACT_COLUMNS = ["position", "column", "kind", "rows", "nulls", "distinct_count",
                "castable", "castable_distinct", "avg_len", "num_min", "num_max", "integral",
                "key_name", "sensible_id_name", "phone_name", "ident_name", "email_name"]


#: Shares of distinct values in the rows at which some rule decides about a column.
RATIO_LIMITS = (0.1, 0.8, 0.9, 0.95)
#: Columns with fewer values are always counted exactly, which costs a handful of rows a task: all
#: rules about a number of values (10 to 200) fall among them.
FEW_VALUES = 256


def _value_structs(df: DataFrame, cols: list[str]):
    """(position, text key, number, low bits) of each column, and which are text, which plain numbers."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    plain, other, text_pos = [], [], []
    for i, c in enumerate(cols):
        dt = fields[c]
        kind = kind_of(dt)
        pos = F.lit(i).alias("pos")
        if kind in ("numeric", "boolean") and not isinstance(dt, T.DecimalType):
            # a double loses up to 11 low bits of a long beyond 2 ** 53
            low = F.when((q(c) > 2 ** 53) | (q(c) < -2 ** 53), q(c).bitwiseAND(F.lit(4095)).cast("int")) \
                if isinstance(dt, T.LongType) else F.lit(None).cast("int")
            plain.append((c, F.struct(pos, numeric_value(c, dt).alias("dk"), low.alias("low"))))
        else:
            number = numeric_value(c, dt) if kind == "numeric" else F.lit(None).cast("double")
            if kind == "string":
                text_pos.append(i)
            other.append((c, F.struct(pos, clean_value(c, dt).cast("string").alias("sk"), number.alias("dk"))))
    return plain, other, text_pos


def _unpivoted(df: DataFrame, structs) -> DataFrame:
    # a narrow scan (one file, one row group) would unpivot in a single task
    return spread(df.select(*[q(c) for c, _ in structs])).select(F.inline(F.array(*[x for _, x in structs])))


def _exact_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Facts per position from one row per distinct value; copies of a value (hot ones
    included) are combined map-side. Numbers and texts are grouped apart, each by the keys it needs:
    numbers by fixed-width ones only; texts once more by the number they spell."""
    plain, other, text_pos = _value_structs(df, cols)
    nonint = F.when(F.col("nv") % 1 != 0, 1)
    parts = []
    if plain:
        values = _unpivoted(df, plain).groupBy("pos", "dk", "low").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("dk", "nv")
        there = F.col("nv").isNotNull()
        parts.append(values.groupBy("pos").agg(
            F.sum("n").alias("rows"), F.sum(F.when(there, F.col("n"))).alias("nn"), F.count("nv").alias("distinct_count"),
            F.sum(F.when(there, F.col("n"))).alias("castable"), F.lit(None).cast("double").alias("avg_len"),
            F.min("nv").alias("num_min"), F.max("nv").alias("num_max"), F.count(nonint).alias("nonint"),
            F.count("nv").alias("castable_distinct")))
    if other:
        is_text = F.col("pos").isin(text_pos) if text_pos else F.lit(False)
        there = F.col("sk").isNotNull()
        values = (_unpivoted(df, other).groupBy("pos", "sk", "dk").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("nv", F.coalesce("dk", F.when(is_text, numeric_value("sk", T.StringType()))))
                  .withColumn("ln", F.when(is_text, F.length("sk"))))
        by_num = values.groupBy("pos", "nv").agg(
            F.sum("n").alias("n"), F.sum(F.when(there, F.col("n"))).alias("nn"), F.count(F.when(there, 1)).alias("groups"),
            F.sum(F.col("ln") * F.col("n")).alias("ln_sum"), F.sum(F.when(F.col("ln").isNotNull(), F.col("n"))).alias("ln_n"))
        spelled = F.col("nv").isNotNull()
        parts.append(by_num.groupBy("pos").agg(
            F.sum("n").alias("rows"), F.sum("nn").alias("nn"), F.sum("groups").alias("distinct_count"),
            F.sum(F.when(spelled, F.col("n"))).alias("castable"), (F.sum("ln_sum") / F.sum("ln_n")).alias("avg_len"),
            F.min("nv").alias("num_min"), F.max("nv").alias("num_max"), F.count(nonint).alias("nonint"),
            F.sum(F.when(spelled, F.when(is_text, 1).otherwise(F.col("groups")))).alias("castable_distinct")))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _sketched_counts(df: DataFrame, cols: list[str], rsd: float) -> DataFrame:
    """Facts per position with HyperLogLog++ distinct counts: one aggregate, no value is shuffled."""
    plain, other, text_pos = _value_structs(df, cols)
    wide = [(c, F.struct(x.getField("pos").alias("pos"), F.lit(None).cast("string").alias("sk"), x.getField("dk").alias("dk"),
                         x.getField("low").alias("low"))) for c, x in plain] \
        + [(c, F.struct(x.getField("pos").alias("pos"), x.getField("sk").alias("sk"), x.getField("dk").alias("dk"),
                        F.lit(None).cast("int").alias("low"))) for c, x in other]
    is_text = F.col("pos").isin(text_pos) if text_pos else F.lit(False)
    there = F.col("sk").isNotNull() | F.col("dk").isNotNull()
    long = _unpivoted(df, wide).withColumn("nv", F.coalesce("dk", F.when(is_text, numeric_value("sk", T.StringType()))))
    return long.groupBy("pos").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(there, 1)).alias("nn"),
        F.approx_count_distinct(F.when(there, F.xxhash64("sk", "dk", "low")), rsd).alias("distinct_count"),
        F.count("nv").alias("castable"), F.approx_count_distinct("nv", rsd).alias("castable_distinct"),
        F.avg(F.when(is_text, F.length("sk"))).alias("avg_len"), F.min("nv").alias("num_min"), F.max("nv").alias("num_max"),
        F.count(F.when(F.col("nv") % 1 != 0, 1)).alias("nonint"))


def column_facts(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                 rsd: float = 0.01) -> DataFrame:
    """Per column: rows, nulls, exact distinct non-null, numeric-castable count and
    distinct, average text length, numeric min/max and whether all values are whole.

    Long form, so the generated code does not grow with the table width.
    ``approx=True`` counts distinct values with HyperLogLog++."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols) if cols is not None else list(fields)
    per = _sketched_counts(df, cols, rsd) if approx else _exact_counts(df, cols)
    meta = df.sparkSession.createDataFrame(
        [(i, c, kind_of(fields[c]), name_has(c, KEY_NAME_PATTERNS), name_has(c, SENSIBLE_ID_PATTERNS),
          name_has(c, PHONE_PATTERNS), name_has(c, IDENTIFIER_KEYWORDS), name_has(c, EMAIL_KEYWORDS))
         for i, c in enumerate(cols)],
        "pos int, column string, kind string, key_name boolean, sensible_id_name boolean, "
        "phone_name boolean, ident_name boolean, email_name boolean")
    f = meta.join(F.broadcast(per), "pos", "left")  # both sides: one row per column
    kind = F.col("kind")
    rows = F.coalesce("rows", F.lit(0)).cast("long")
    nn = F.coalesce("nn", F.lit(0)).cast("long")
    castable = F.coalesce("castable", F.lit(0)).cast("long")
    return f.select(
        F.col("pos").alias("position"), "column", "kind", rows.alias("rows"), (rows - nn).alias("nulls"),
        F.coalesce("distinct_count", F.lit(0)).cast("long").alias("distinct_count"),
        castable.alias("castable"),
        F.coalesce("castable_distinct", F.lit(0)).cast("long").alias("castable_distinct"),
        F.when(kind == "string", F.col("avg_len")).cast("double").alias("avg_len"),
        F.col("num_min").cast("double").alias("num_min"), F.col("num_max").cast("double").alias("num_max"),
        ((castable > 0) & (F.coalesce("nonint", F.lit(0)) == 0)).alias("integral"),
        "key_name", "sensible_id_name", "phone_name", "ident_name", "email_name")


def undecided_columns(rows: list[dict], rsd: float, sigmas: float = 5.0) -> list[str]:
    """Columns whose sketched counts leave some rule open: a limit lies within ``sigmas``
    standard errors of an estimate, or the column has few values."""
    def open_(count: int, of: int) -> bool:
        if count <= FEW_VALUES:
            return True
        lo, hi = count / (1 + sigmas * rsd), count / (1 - sigmas * rsd)
        return any(lo <= r * of <= hi for r in RATIO_LIMITS)

    return [r["column"] for r in rows if open_(r["distinct_count"], r["rows"])
            or (r["kind"] == "string" and r["castable"] and open_(r["castable_distinct"], r["castable"]))]


def decisive_facts(df: DataFrame, cols: list[str] | None = None, rsd: float = 0.005) -> DataFrame:
    """``column_facts`` as far as rules need it, plus ``counted``: one sketch pass over all
    columns, then an exact recount of just those that ``undecided_columns`` names. The other
    columns keep estimates that lie clear of every limit, so every role comes out as
    from exact counts, but their values are never shuffled."""
    sketched = column_facts(df, cols, approx=True, rsd=rsd)
    rows = facts_rows(sketched)
    again = undecided_columns(rows, rsd)
    if again:
        exact = {r["column"]: r for r in facts_rows(column_facts(df, again))}
        rows = [{**exact[r["column"]], "position": r["position"]} if r["column"] in exact else r for r in rows]
    schema = T.StructType([*sketched.schema.fields, T.StructField("counted", T.BooleanType())])
    return df.sparkSession.createDataFrame([tuple(r[c] for c in sketched.columns) + (r["column"] in again,) for r in rows], schema)


def facts_rows(facts: DataFrame) -> list[dict]:
    """Collect the fact rows (one per column: bounded by the schema, not the data)."""
    return [r.asDict() for r in facts.orderBy("position").collect()]


def numeric_columns_of(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric"]


def typed(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


__all__ = ["column_facts", "facts_rows", "FACT_COLUMNS", "numeric_columns_of", "q"]
