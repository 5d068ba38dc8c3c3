"""Filter / sort / page exploration (F1-F11) and top-k (F8)."""

from __future__ import annotations

import math
import struct
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import numeric_value, q
from ..plans.facts import column_facts
from ..plans.roles import role_columns
from ..sources.io import null_to_display, number_rows, with_global_index
from .stats import value_counts


def _dtype(df, c):
    return df.schema[c].dataType


_WHOLE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _bound(x, dt: T.DataType, up: bool):
    """A range bound as a literal of the column's own type, so that it reaches the scan:
    the least value of the type from ``x`` on (``up``), or the greatest up to it. None where every
    value of the type fits, False where none does."""
    exact = Fraction(x) if not isinstance(x, float) or math.isfinite(x) else None
    if exact is None:
        return False if math.isnan(x) or (x > 0) == up else None
    if type(dt) in _WHOLE or isinstance(dt, T.DecimalType):
        scale = dt.scale if isinstance(dt, T.DecimalType) else 0
        units = math.ceil(exact * 10 ** scale) if up else math.floor(exact * 10 ** scale)
        most = 10 ** dt.precision - 1 if isinstance(dt, T.DecimalType) else 2 ** _WHOLE[type(dt)] - 1
        least = -most if isinstance(dt, T.DecimalType) else -most - 1
        if not least <= units <= most:
            return False if (units > most) == up else None
        if isinstance(dt, T.DecimalType):
            sign, digits = "-" if units < 0 else "", f"{abs(units):0{scale + 1}d}"
            return F.lit(sign + (digits[:-scale] + "." + digits[-scale:] if scale else digits)).cast(dt)
        return F.lit(units).cast(dt)
    value = float(x)
    if isinstance(dt, T.FloatType):
        near = struct.unpack("f", struct.pack("f", max(min(value, 3.4028234663852886e38), -3.4028234663852886e38)))[0]
        if (near < value) if up else (near > value):              # the next float on the right side
            bits = struct.unpack("i", struct.pack("f", near))[0]
            step = 1 if (near > 0 or (near == 0 and up)) == up else -1
            near = math.copysign(1e-45, 1 if up else -1) if near == 0 else struct.unpack("f", struct.pack("i", bits + step))[0]
        return F.lit(near).cast("float")
    return F.lit(value)


def filter_range(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    """inclusive numeric range; values that are not numbers never pass. Numeric columns
    are compared as they are with bounds of their own type, exactly and within the scan."""
    dt = _dtype(df, col)
    own = type(dt) in _WHOLE or isinstance(dt, (T.DecimalType, T.FloatType, T.DoubleType))
    v = q(col) if own else numeric_value(col, dt)
    cond = v.isNotNull()
    if isinstance(dt, (T.FloatType, T.DoubleType)):               # NaN counts as larger than any number
        cond = cond & ~F.isnan(v)
    for x, up in ((lo, True), (hi, False)):
        if x is None:
            continue
        bound = _bound(x, dt if own else T.DoubleType(), up)
        if bound is False:
            return df.filter(F.lit(False))
        if bound is not None:
            cond = cond & (v >= bound if up else v <= bound)
    return df.filter(cond)


def filter_in(df: DataFrame, col: str, values: list) -> DataFrame:
    """membership; an empty list is no filter."""
    return df.filter(q(col).isin(list(values))) if values else df


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """equality."""
    return df.filter(q(col) == F.lit(value))


def apply_filters(df: DataFrame, spec: dict | None) -> DataFrame:
    """AND of range ({'min','max'}), membership (list) and equality filters;
    unknown columns are ignored. All land in one Filter node that Catalyst
    pushes into the scan."""
    for col, f in (spec or {}).items():
        if col not in df.columns:
            continue
        if isinstance(f, dict):
            df = filter_range(df, col, f.get("min"), f.get("max"))
        elif isinstance(f, (list, tuple)):
            df = filter_in(df, col, f)
        else:
            df = filter_eq(df, col, f)
    return df


def sort_keys(df: DataFrame, col: str | None, order: str = "asc", tiebreak: list[str] | None = None) -> list:
    """F5 ordering: nulls last in both directions; unknown column = no sort key;
    ``tiebreak`` columns (default: all columns) make the order total."""
    keys = []
    if col and col in df.columns:
        keys.append(q(col).asc_nulls_last() if order.lower() == "asc" else q(col).desc_nulls_last())
    for c in (tiebreak if tiebreak is not None else df.columns):
        keys.append(q(c).asc_nulls_last())
    return keys


def sort_rows(df: DataFrame, col: str | None, order: str = "asc", tiebreak: list[str] | None = None) -> DataFrame:
    """F5."""
    return df.orderBy(*sort_keys(df, col, order, tiebreak))


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(1, int(page)), min(500, max(10, int(size)))


_SHALLOW = 10_000          # rows up to which a page is a top-n of every task
_SPLITTERS = 15            # keys a pass of the rank search counts against


def _literal(value, dt: T.DataType):
    if isinstance(dt, T.TimestampNTZType) and value is not None:
        return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")
    return F.lit(value).cast(dt)


def _before(keys: list[tuple[str, bool, T.DataType]], at: tuple):
    """Rows that sort before the key ``at``: (column, ascending, type) keys, nulls last in both directions."""
    out = F.lit(False)
    for (c, up, dt), value in reversed(list(zip(keys, at))):
        here, v = _literal(value, dt), q(c)
        less = v.isNotNull() if value is None else F.coalesce(v < here if up else v > here, F.lit(False))
        out = less | (v.eqNullSafe(here) & out)
    return out


def _key_range(df: DataFrame, keys: list[tuple[str, bool, T.DataType]], start: int, end: int, total: int, most: int):
    """(rows of a range of keys that holds the ranks from ``start`` to ``end``, their number,
    rows before them).

    Every pass takes a few keys of the range (those of least hash), counts exactly how many
    rows sort before each, and goes on between the two around the ranks. The range is a
    filter, which for the first key reaches the scan. Ends when at most ``most`` rows are left, or
    equal keys let it shrink no further."""
    names = list(dict.fromkeys(c for c, _, _ in keys))
    part, before, size, idle = df, 0, total, 0
    up, dt = keys[0][1:]
    while size > most and idle < 3:
        h = F.xxhash64(*[q(c) for c in names], F.lit(size), F.lit(idle))
        found = part.select(*[q(c) for c in names]).distinct().orderBy(h).limit(_SPLITTERS).collect()
        at = [tuple(r[c] for c, _, _ in keys) for r in found]
        row = part.agg(*[F.count(F.when(_before(keys, a), 1)).alias(f"n{i}") for i, a in enumerate(at)]).collect()[0]
        counts = sorted((row[f"n{i}"], i) for i in range(len(at)))
        lo = max((x for x in counts if x[0] <= start - before), default=(0, None))
        hi = min((x for x in counts if x[0] >= end - before and x[0] > lo[0]), default=(size, None))
        idle = idle + 1 if hi[0] - lo[0] == size else 0
        for (n, i), from_it in ((lo, True), (hi, False)):
            if i is None or (from_it and not n):
                continue
            part = part.filter(~_before(keys, at[i]) if from_it else _before(keys, at[i]))
            if at[i][0] is not None:                              # once more, as the scan understands it
                v, first = q(keys[0][0]), _literal(at[i][0], dt)
                part = part.filter(v <= first if up else v >= first) if not from_it else \
                    part.filter((v >= first if up else v <= first) | v.isNull())
        before, size = before + lo[0], hi[0] - lo[0]
    return part, size, before


def paginate(df: DataFrame, page: int = 1, size: int = 50, sort_by: str | None = None,
             order: str = "asc", tiebreak: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, pagination facts). Page >= 1, size clamped to 10..500.

    The first pages are a top-n: every task keeps as many rows as the page reaches. For a
    page further on the keys around it are searched by exact counts, and only that range of
    keys is read and sorted. Nothing is sorted or written as a whole."""
    page, size = clamp_page(page, size)
    start, total = (page - 1) * size, df.count()
    keys = sort_keys(df, sort_by, order, tiebreak)
    if start >= total:
        rows = df.limit(0)
    elif start + size <= _SHALLOW or not keys:
        rows = df.orderBy(*keys).offset(start).limit(size)
    else:
        names = [(sort_by, order.lower() == "asc", _dtype(df, sort_by))] if sort_by and sort_by in df.columns else []
        names += [(c, True, _dtype(df, c)) for c in (tiebreak if tiebreak is not None else df.columns)]
        part, held, before = _key_range(df, names, start, min(start + size, total), total, _SHALLOW)
        if held > _SHALLOW:                                       # very many equal keys
            idx = with_global_index(part, keys, "__row")
            rows = idx.filter((F.col("__row") >= start - before) & (F.col("__row") < start - before + size)).orderBy("__row").drop("__row")
        else:
            rows = part.orderBy(*keys).offset(start - before).limit(size)
    return rows, _page_facts(df.sparkSession, page, size, total)


def _page_facts(spark, page: int, size: int, total: int) -> DataFrame:
    return spark.createDataFrame(
        [(page, size, total, -(-total // size), page * size < total, page > 1)],
        "page int, page_size int, total_rows long, total_pages long, has_next boolean, has_prev boolean")


def page_in_order(df: DataFrame, page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """One page of a frame in the order it comes in, and the pagination facts. First pages
    are cut off the plan (a top-n where it ends in a sort); later ones are numbered."""
    page, size = clamp_page(page, size)
    start, total = (page - 1) * size, df.count()
    if start + size <= _SHALLOW:
        rows = df.offset(start).limit(size)
    else:
        idx = number_rows(df, "__row")
        rows = idx.filter((F.col("__row") >= start) & (F.col("__row") < start + size)).orderBy("__row").drop("__row")
    return rows, _page_facts(df.sparkSession, page, size, total)


def explore_column_info(df: DataFrame, primary_keys: list[str] | None = None, top: int | None = 20,
                        max_values: int | None = 50) -> tuple[DataFrame, DataFrame]:
    """per column (after filters) distinct and null counts, numeric and
    categorical roles, min/max when numeric; plus the ``top`` values (nulls
    excluded; None: all) of categorical columns with at most ``max_values`` distinct ones (None: any number)."""
    facts = column_facts(df)
    roles = role_columns(facts, primary_keys=primary_keys)
    info = roles.select("position", F.col("column").alias("name"), "is_numeric", "is_categorical",
                        F.col("distinct_count").alias("unique_count"), F.col("nulls").alias("null_count"),
                        F.when(F.col("is_numeric"), F.col("num_min")).alias("min"),
                        F.when(F.col("is_numeric"), F.col("num_max")).alias("max"))
    few = F.col("is_categorical") & (F.col("unique_count") <= max_values if max_values is not None else F.lit(True))
    sel = [r["name"] for r in info.filter(few).select("name").collect()]
    if sel:
        values = (value_counts(df, sel, top=top, drop_nan_text=False, include_null=False)
                  .select("column", "value", "count", "rank"))
    else:
        values = df.sparkSession.createDataFrame([], "column string, value string, count long, rank int")
    return info, values


def top_n(df: DataFrame, col: str, n: int = 10, tiebreak: list[str] | None = None) -> DataFrame:
    """F8: the ``n`` largest rows by ``col`` (TakeOrderedAndProject: each task keeps n)."""
    keys = [q(col).desc_nulls_last()] + [q(c).asc_nulls_last() for c in (tiebreak or [])]
    return df.orderBy(*keys).limit(n)


def select_columns(df: DataFrame, cols: list[str] | None = None, drop: list[str] | None = None) -> DataFrame:
    """projection / drop (pruned down to the scan)."""
    if cols:
        df = df.select(*[q(c) for c in cols])
    if drop:
        df = df.drop(*drop)
    return df


def drop_null_rows(df: DataFrame, subset: list[str]) -> DataFrame:
    """drop rows with a null in any of ``subset``."""
    if not subset:
        return df
    return df.filter(reduce(lambda a, b: a & b, [q(c).isNotNull() for c in subset]))


def explore(df: DataFrame, filters: dict | None = None, sort_by: str | None = None,
            sort_order: str = "asc", page: int = 1, page_size: int = 50,
            primary_keys: list[str] | None = None) -> dict[str, DataFrame]:
    """filters -> sort -> page, plus column info of the filtered data.
    Page rows are returned for display (NULL as '')."""
    f = apply_filters(df, filters)
    rows, meta = paginate(f, page, page_size, sort_by, sort_order)
    info, top = explore_column_info(f, primary_keys)
    return {"data": null_to_display(rows), "pagination": meta, "columns": info, "top_values": top}
