"""Time series (W1-W5): series views, centred moving average, stats and trend.

A series at scale is one long ordered sequence, so nothing here uses an
un-partitioned window over the data: positions come from a range-partitioned
sort with per-partition offsets, and the moving average is a window inside buckets of
neighbouring positions, to which only the few rows at a bucket's borders are copied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import kind_of, numeric_value, q
from ..sources.io import with_global_index

TS_FMT = "yyyy-MM-dd HH:mm:ss"
_BUCKET = 8192             # neighbouring positions of a series in one window group


def _ts(df, col):
    dt = df.schema[col].dataType
    return q(col) if kind_of(dt) == "datetime" else F.try_to_timestamp(q(col).cast("string"))


def series_view(df: DataFrame, ts: str, val: str, key: str | None = None,
                min_rows: int = 10, min_dates: int = 3) -> DataFrame:
    """(ts, value[, key]) with both present, sorted by date (then key);
    empty unless >= ``min_rows`` rows and >= ``min_dates`` distinct dates."""
    cols = [_ts(df, ts).alias("ts"), numeric_value(val, df.schema[val].dataType).alias("value")]
    if key:
        cols.append(q(key).alias("key"))
    s = df.select(*cols).filter(F.col("ts").isNotNull() & F.col("value").isNotNull())
    chk = s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ts").alias("d")).collect()[0]
    if chk["n"] < min_rows or chk["d"] < min_dates:
        return s.limit(0)
    return s.orderBy("ts", *(["key"] if key else []))


def moving_average_width(n: int) -> int | None:
    return min(7, n // 3) if n > 7 else None


def centered_moving_average(df: DataFrame, ts: str, val: str, key: str,
                            partition_by: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Centred moving average of width w = min(7, n // 3) (n > 7), NULL unless
    the window is full. For width w the window of row i spans rows
    [i - (w - 1 - off), i + off] with off = (w - 1) // 2.

    Rows are numbered (distributed) and put into buckets by position; rows within a
    window's reach of a border go to the next bucket too, so every bucket has the whole
    windows of its own rows and no task sees the series. ``partition_by``: many independent
    series, each with its own width, over one global numbering, so a hot series is never one task.
    """
    v = numeric_value(val, df.schema[val].dataType)
    base = df.select(*[q(c) for c in (partition_by or [])], _ts(df, ts).alias("ts"),
                     v.alias("value"), q(key).alias("key")).filter(
        F.col("ts").isNotNull() & F.col("value").isNotNull())
    if partition_by:
        return _moving_average_per_series(base, partition_by)
    n = base.count()
    w = width or moving_average_width(n)
    if not w:
        return base.withColumn("trend", F.lit(None).cast("double"))
    off = (w - 1) // 2
    idx = with_global_index(base, [F.col("ts"), F.col("key")], "idx")
    near = Window.partitionBy("_bucket").orderBy("idx").rowsBetween(-(w - 1 - off), off)
    out = _with_halo(idx, "idx", w - 1).withColumn("_s", F.sum("value").over(near)).withColumn("_c", F.count(F.lit(1)).over(near))
    return out.filter("_own").select("ts", "value", "key", "idx", F.when(F.col("_c") == w, F.col("_s") / w).alias("trend"))


def _with_halo(idx: DataFrame, pos: str, reach: int) -> DataFrame:
    """Rows with their bucket of neighbouring positions (``_bucket``); those within
    ``reach`` of a border once more, not ``_own``, in the bucket beyond it."""
    size = max(_BUCKET, 4 * reach)
    at, b = F.col(pos) % size, F.floor(F.col(pos) / size)
    where = F.array(F.struct(b.alias("_bucket"), F.lit(True).alias("_own")))
    before = F.array(F.struct((b - 1).alias("_bucket"), F.lit(False).alias("_own")))
    after = F.array(F.struct((b + 1).alias("_bucket"), F.lit(False).alias("_own")))
    copies = F.when(at < reach, F.concat(where, before)).when(at >= size - reach, F.concat(where, after)).otherwise(where)
    return idx.select("*", F.inline(copies))


def series_stats(df: DataFrame, pairs: list[tuple[str, str]], key: str,
                 min_rows: int = 10, min_dates: int = 3) -> DataFrame:
    """W3 + W4 for many (date, value) pairs in ONE aggregate: points, first and
    last date, mean, sample std, and trend ('increasing' when the last value in
    (date, key) order exceeds the first). Pairs failing W1's checks are left out."""
    structs = []
    aggs = []
    for i, (t, v) in enumerate(pairs):
        tv, vv = _ts(df, t), numeric_value(v, df.schema[v].dataType)
        both = tv.isNotNull() & vv.isNotNull()
        order = F.struct(tv, q(key))
        aggs += [F.count(F.when(both, 1)).alias(f"n{i}"), F.count_distinct(F.when(both, tv)).alias(f"d{i}"),
                 F.min(F.when(both, tv)).alias(f"t0{i}"), F.max(F.when(both, tv)).alias(f"t1{i}"),
                 F.avg(F.when(both, vv)).alias(f"m{i}"), F.stddev_samp(F.when(both, vv)).alias(f"s{i}"),
                 F.min_by(vv, F.when(both, order)).alias(f"f{i}"), F.max_by(vv, F.when(both, order)).alias(f"l{i}")]
        structs.append(F.struct(
            F.lit(t).alias("date_column"), F.lit(v).alias("value_column"),
            F.col(f"n{i}").cast("long").alias("points"), F.col(f"d{i}").cast("long").alias("dates"),
            F.date_format(f"t0{i}", TS_FMT).alias("start_date"), F.date_format(f"t1{i}", TS_FMT).alias("end_date"),
            F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
            F.when(F.col(f"l{i}") > F.col(f"f{i}"), "increasing").otherwise("decreasing").alias("trend_direction")))
    row = df.agg(*aggs)
    out = row.select(F.inline(F.array(*structs)))
    return out.filter((F.col("points") >= min_rows) & (F.col("dates") >= min_dates)).drop("dates")


def trend_direction(df: DataFrame, ts: str, val: str, key: str) -> DataFrame:
    """W4 alone: one row (date_column, value_column, trend_direction)."""
    return series_stats(df, [(ts, val)], key, 0, 0).select("date_column", "value_column", "trend_direction")


def timeseries(df: DataFrame, key: str, date_cols: list[str], numeric_cols: list[str],
               max_dates: int | None = None, max_values: int | None = None) -> DataFrame:
    """Every date column x every numeric column, all pairs in one aggregate;
    ``max_dates`` / ``max_values`` keep only the first columns."""
    pairs = [(t, v) for t in date_cols[:max_dates] for v in numeric_cols[:max_values]]
    return series_stats(df, pairs, key)


def _moving_average_per_series(base: DataFrame, partition_by: list[str]) -> DataFrame:
    """W2 for many series at once: numbered over (series, ts, key), windows of at most 7
    rows of the same series inside buckets of positions. The size of each series joins back
    by its key; AQE splits a hot one."""
    keys = [q(c) for c in partition_by]
    idx = with_global_index(base, keys + [F.col("ts"), F.col("key")], "gi")
    per = idx.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    series = Window.partitionBy("_bucket", *keys).orderBy("gi")
    at = [F.lag("value", -d).over(series) if d else F.col("value") for d in range(-3, 4)]
    near = _with_halo(idx, "gi", 6).select("*", *[v.alias(f"_v{i}") for i, v in enumerate(at)]).filter("_own")
    out = near.join(per, partition_by)
    w = F.when(F.col("_n") > 7, F.least(F.lit(7), F.floor(F.col("_n") / 3)).cast("int"))
    trend = F.lit(None).cast("double")
    for width in range(2, 8):
        off = (width - 1) // 2
        members = [F.col(f"_v{3 + d}") for d in range(-(width - 1 - off), off + 1)]   # a missing one makes the sum NULL
        trend = F.when(w == width, sum(members[1:], members[0]) / width).otherwise(trend)
    return out.select(*[q(c) for c in partition_by], "ts", "value", "key", trend.alias("trend"))
