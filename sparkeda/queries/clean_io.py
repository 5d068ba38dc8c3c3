"""Cleaning (K1-K8) and source/sink (S1-S9) queries with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..plans import roles as ro
from ..registry import register, table
from ..session import checkpoint_dir
from ..sources import derived as dv
from ..sources import io
from ._sql import with_views

_BLANK = ["event_id", "ts", "user_id", "event_type", "props"]


def _mask_sql(strict: bool) -> str:
    all_null = " AND ".join(f"{c} IS NULL" for c in _BLANK)
    if strict:
        all_blank = " AND ".join(f"({c} IS NULL OR trim({c}) = '')" for c in _BLANK)
    else:
        all_blank = " AND ".join(f"coalesce(trim({c}) = '', false)" for c in _BLANK)
    return f"(({all_null}) OR ({all_blank}))"


register("drop_empty_rows_events_blank",
         with_views("events_blank") + f"\nSELECT * FROM events_blank WHERE NOT {_mask_sql(False)}")(
    lambda spark, sf: cl.drop_empty_rows(dv.events_blank(spark, sf)))
register("drop_empty_rows_strict_events_blank",
         with_views("events_blank") + f"\nSELECT * FROM events_blank WHERE NOT {_mask_sql(True)}")(
    lambda spark, sf: cl.drop_empty_rows(dv.events_blank(spark, sf), strict=True))

register("drop_empty_columns_events",
         with_views("events_empty_cols") + "\nSELECT event_id, event_type, value FROM events_empty_cols")(
    lambda spark, sf: cl.drop_empty_columns(dv.events_empty_cols(spark, sf)))

register("parse_boolean_words_events",
         with_views("events_words") + """
SELECT event_id, CAST(CASE lower(trim(yn)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS INTEGER) AS yn,
       CAST(CASE lower(trim(tf)) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS INTEGER) AS tf,
       all_yes, event_type FROM events_words""")(
    lambda spark, sf: cl.parse_boolean_words(dv.events_words(spark, sf)))

register("parse_datetime_events_dates",
         with_views("events_dates") + """
SELECT event_id, strftime(strptime(d_iso, '%Y-%m-%d'), '%Y-%m-%d %H:%M:%S') AS d_iso,
       strftime(strptime(d_us, '%m/%d/%Y'), '%Y-%m-%d %H:%M:%S') AS d_us, d_garbage, event_type
FROM events_dates""")(
    lambda spark, sf: _ts_text(cl.parse_datetime_columns(dv.events_dates(spark, sf)), ["d_iso", "d_us"]))


_SPELLED = ["d_short", "d_zulu", "d_month", "d_minutes"]
register("parse_datetime_events_spellings", """
SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS d_short,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS d_zulu,
       strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS d_month,
       strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS d_minutes FROM events""")(
    lambda spark, sf: _ts_text(cl.parse_datetime_columns(dv.events_spellings(spark, sf)), _SPELLED))
register("datetime_columns_events_spellings",
         "SELECT i AS position, c AS \"column\" FROM (VALUES (1, 'd_short'), (2, 'd_zulu'), (3, 'd_month'), (4, 'd_minutes')) v(i, c) "
         "WHERE (SELECT count(*) FROM events WHERE ts IS NOT NULL) > 0.8 * (SELECT count(*) FROM events)")(
    lambda spark, sf: ro.detect_datetime_columns(dv.events_spellings(spark, sf)))


def _ts_text(df, cols):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


register("drop_duplicates_orders_dup",
         with_views("orders_dup") + """
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders_dup""")(
    lambda spark, sf: _ts_text(cl.drop_duplicate_rows(dv.orders_dup(spark, sf)), ["o_orderdate"]))

register("normalize_names_events",
         'SELECT event_id AS event_id, user_id AS user_id, value AS value, event_type AS value_1 FROM events')(
    lambda spark, sf: cl.normalize_column_names(dv.events_headers(spark, sf)))

register("clean_orders_dup",
         with_views("orders_dup") + """
SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders_dup""")(
    lambda spark, sf: _ts_text(cl.clean(dv.orders_dup(spark, sf)), ["o_orderdate"]))

register("clean_events_words",
         with_views("events_words") + """
SELECT DISTINCT event_id, CAST(CASE lower(trim(yn)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS INTEGER) AS yn,
       CAST(CASE lower(trim(tf)) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS INTEGER) AS tf,
       all_yes, event_type FROM events_words""")(
    lambda spark, sf: cl.clean(dv.events_words(spark, sf)))

register("clean_events_blank",
         with_views("events_blank") + f"""
SELECT DISTINCT event_id, ts, user_id, event_type, props FROM events_blank WHERE NOT {_mask_sql(False)}""")(
    lambda spark, sf: _ts_text(cl.clean(dv.events_blank(spark, sf)), ["ts"]))

register("cleaning_plan_events_dates")(
    lambda spark, sf: cl.cleaning_plan(dv.events_dates(spark, sf)))

register("null_to_display_events_missing",
         with_views("events_missing") + """
SELECT coalesce(CAST(event_id AS VARCHAR), '') AS event_id, coalesce(CAST(ts AS VARCHAR), '') AS ts,
  coalesce(CAST(user_id AS VARCHAR), '') AS user_id, coalesce(event_type, '') AS event_type,
  coalesce(CAST(value AS VARCHAR), '') AS value, coalesce(props, '') AS props FROM events_missing""")(
    lambda spark, sf: io.null_to_display(dv.events_missing(spark, sf)))

register("preview_events_missing",
         with_views("events_missing") + """
SELECT coalesce(CAST(event_id AS VARCHAR), '') AS event_id, coalesce(CAST(ts AS VARCHAR), '') AS ts,
  coalesce(CAST(user_id AS VARCHAR), '') AS user_id, coalesce(event_type, '') AS event_type,
  coalesce(CAST(value AS VARCHAR), '') AS value, coalesce(props, '') AS props
FROM events_missing ORDER BY events_missing.event_id LIMIT 10""")(
    lambda spark, sf: io.preview(dv.events_missing(spark, sf), ["event_id"], 10))

_INV = [("benchmark", 2), ("conversations", 4), ("customer", 5), ("documents", 5), ("embeddings", 3),
        ("events", 6), ("labels", 3), ("lineitem", 11), ("nation", 3), ("orders", 6), ("pages", 3),
        ("part", 6), ("region", 2), ("supplier", 4)]
register("dataset_inventory",
         "\nUNION ALL\n".join(f"SELECT '{t}' AS dataset, CAST(count(*) AS BIGINT) AS rows, "
                              f"CAST({n} AS BIGINT) AS columns FROM {t}" for t, n in _INV))(
    lambda spark, sf: io.dataset_inventory(spark, sf, [t for t, _ in _INV]))

register("downsample_events",
         """SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i,
         greatest(1, count(*) OVER () // 3000) AS step FROM events) WHERE i % step = 0""")(
    lambda spark, sf: io.downsample_ordered(table(spark, sf, "events"), ["ts", "event_id"], 3000))


@register("sample_rows_lineitem", """SELECT * FROM lineitem ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '|' ||
  CAST(l_linenumber AS VARCHAR) || '|sample42'), l_orderkey, l_linenumber LIMIT 5000""")
def _sample(spark, sf):
    li = table(spark, sf, "lineitem")
    return io.sample_rows(li, 5000, keys=["l_orderkey", "l_linenumber"])


def _roundtrip(spark, sf, name):
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{name}-{uuid.uuid4().hex}"
    src = table(spark, sf, name)
    ts_cols = [f.name for f in src.schema.fields if f.dataType.typeName().startswith("timestamp")]
    io.write_csv(_ts_text(src, ts_cols), path)
    return io.read_table(spark, path, fmt="csv")


register("csv_roundtrip_orders",
         "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
         "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")(
    lambda spark, sf: _roundtrip(spark, sf, "orders"))
register("csv_roundtrip_documents", "SELECT * FROM documents")(
    lambda spark, sf: _roundtrip(spark, sf, "documents"))
register("csv_roundtrip_customer", "SELECT * FROM customer")(
    lambda spark, sf: _roundtrip(spark, sf, "customer"))


@register("csv_roundtrip_orders_long_ids",
          "SELECT CAST(1152921504606846976 + o_orderkey AS BIGINT) AS order_id, "
          "CAST(9223372036854775807 - o_orderkey AS BIGINT) AS back_id, o_custkey FROM orders")
def _long_ids(spark, sf):
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-ids-{uuid.uuid4().hex}"
    key = F.col("o_orderkey").cast("long")
    io.write_csv(table(spark, sf, "orders").select((F.lit(2 ** 60) + key).alias("order_id"),
                                                   (F.lit(2 ** 63 - 1) - key).alias("back_id"), "o_custkey"), path)
    return io.read_table(spark, path, fmt="csv")


register("read_parquet_nation", "SELECT * FROM nation")(
    lambda spark, sf: io.read_table(spark, f"{sf.rstrip('/')}/nation.parquet"))
