"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import NUMBER_RE

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(dt: T.DataType) -> str:
    """Coarse kind used by role inference: numeric, string, datetime, boolean, other."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def q(name: str) -> Column:
    """Column by exact name (names may hold spaces, dots or dashes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_value(name: str, dt: T.DataType) -> Column:
    """The column with NaN turned into NULL (Spark counts NaN as a value)."""
    c = q(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def numeric_value(name: str, dt: T.DataType) -> Column:
    """Value as double, or NULL when it is not a plain number (cast-or-null)."""
    c = q(name)
    if isinstance(dt, NUMERIC_TYPES):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(dt, T.BooleanType):
        return c.cast("double")
    if isinstance(dt, T.StringType):
        d = F.expr("try_cast(trim(`%s`) as double)" % name.replace("`", "``"))
        return F.when(c.rlike(NUMBER_RE) & ~F.isnan(d), d)
    return F.lit(None).cast("double")


# Python's whitespace set (str.strip / re's \s), as literal characters
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Python ``str.strip()`` as a character-set trim."""
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """Cell that is an empty string after stripping whitespace (NULL is not blank)."""
    return strip(c.cast("string")) == F.lit("")


def bin_index(v: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin of ``v`` over [lo, hi]; the last bin is closed."""
    width = (hi - lo) / bins
    # ``least`` skips NULL, so keep NULL values out of the last bin explicitly
    return F.when(v.isNotNull(), F.least(F.floor((v - F.lit(lo)) / F.lit(width)),
                                         F.lit(bins - 1))).cast("int")


def bias_corrected_skew(g1: Column, n: Column) -> Column:
    """Sample skewness G1 from the population moment g1 (NULL below 3 values; 0 when constant)."""
    return F.when(n >= 3, F.coalesce(g1 * F.sqrt(n * (n - 1)) / (n - 2), F.lit(0.0)))


def bias_corrected_kurt(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis G2 from the population excess kurtosis g2."""
    return F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), F.lit(0.0)))


def rnd(c: Column, digits: int = 4) -> Column:
    """Round half away from zero with plain IEEE arithmetic, so that any SQL engine doing the
    same three operations gets the very same double (``round`` differs between
    engines on ties such as 0.00015)."""
    scale = float(10 ** digits)
    t = F.abs(c) * F.lit(scale) + F.lit(0.5)
    return F.signum(c) * ((t - t % F.lit(1.0)) / F.lit(scale))


def r4(c: Column) -> Column:
    return rnd(c, 4)


def local_frame(df: DataFrame) -> DataFrame:
    """Materialise a tiny result (one row per column, say) so later plans reuse it
    instead of recomputing its aggregate. Only for frames bounded by the schema."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def unpivot_values(df: DataFrame, cols: list[str], value: Column | None = None,
                   value_fn=None, name_col: str = "column", value_col: str = "value") -> DataFrame:
    """Long form (column, value) of the given columns: one narrow explode, no shuffle."""
    structs = []
    for i, c in enumerate(cols):
        v = value_fn(c) if value_fn else q(c)
        structs.append(F.struct(F.lit(c).alias(name_col), F.lit(i).alias("position"),
                                v.alias(value_col)))
    return df.select(F.inline(F.array(*structs)))


def json_object(df) -> Column:
    """A row of ``df`` as a JSON object: nulls are written, non-finite numbers become null."""
    def finite(f):
        if f.dataType.typeName() not in ("double", "float"):
            return q(f.name)
        bad = F.isnan(q(f.name)) | (F.abs(q(f.name)) == F.lit(float("inf")))
        return F.when(~bad, q(f.name)).alias(f.name)

    return F.to_json(F.struct(*[finite(f) for f in df.schema.fields]), {"ignoreNullFields": "false"})
