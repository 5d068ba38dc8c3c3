"""Profile statistic queries (G1-G8, G13, G14, K7) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import stats as st
from ..registry import register, table
from ..sources import derived as dv
from ._sql import TABLES, qi, rnd as srnd, with_views

R4 = ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]


def _round_cols(df, cols, digits=4):
    return df.select(*[rnd(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def numeric_stats_sql(source: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        v = f"CAST({qi(c)} AS DOUBLE)"
        n = f"count({v})"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", CAST({n} AS BIGINT) AS count, "
            f"CAST(count(*) - {n} AS BIGINT) AS missing, {srnd(f'avg({v})')} AS mean, "
            f"{srnd(f'quantile_cont({v}, 0.5)')} AS median, {srnd(f'stddev_samp({v})')} AS std, "
            f"{srnd(f'min({v})')} AS min, {srnd(f'max({v})')} AS max, "
            f"{srnd(f'quantile_cont({v}, 0.25)')} AS q25, {srnd(f'quantile_cont({v}, 0.75)')} AS q75, "
            f"CASE WHEN {n} >= 3 THEN {srnd(f'coalesce(skewness({v}), 0)')} END AS skewness, "
            f"CASE WHEN {n} >= 4 THEN {srnd(f'coalesce(kurtosis({v}), 0)')} END AS kurtosis FROM {source}")
    return "\nUNION ALL\n".join(parts)


def _numeric_q(source_fn, cols):
    return lambda spark, sf: _round_cols(st.numeric_stats(source_fn(spark, sf), cols), R4)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
register("numeric_stats_lineitem", numeric_stats_sql("lineitem", _LI_NUM))(
    _numeric_q(lambda s, f: table(s, f, "lineitem"), _LI_NUM))
register("numeric_stats_events", numeric_stats_sql("events", ["user_id", "value"]))(
    _numeric_q(lambda s, f: table(s, f, "events"), ["user_id", "value"]))
register("numeric_stats_events_missing",
         with_views("events_missing") + "\n" + numeric_stats_sql("events_missing", ["user_id", "value"]))(
    _numeric_q(dv.events_missing, ["user_id", "value"]))
register("numeric_stats_lineitem_const",
         with_views("lineitem_const") + "\n" + numeric_stats_sql("lineitem_const", ["c_const", "l_quantity"]))(
    _numeric_q(dv.lineitem_const, ["c_const", "l_quantity"]))
register("numeric_stats_customer", numeric_stats_sql("customer", ["c_acctbal", "c_nationkey"]))(
    _numeric_q(lambda s, f: table(s, f, "customer"), ["c_acctbal", "c_nationkey"]))
register("numeric_stats_orders", numeric_stats_sql("orders", ["o_totalprice", "o_custkey"]))(
    _numeric_q(lambda s, f: table(s, f, "orders"), ["o_totalprice", "o_custkey"]))


def shape_sql(source, cols):
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", "
        f"CASE WHEN count({qi(c)}) >= 3 THEN {srnd(f'coalesce(skewness(CAST({qi(c)} AS DOUBLE)), 0)')} END AS skewness, "
        f"CASE WHEN count({qi(c)}) >= 4 THEN {srnd(f'coalesce(kurtosis(CAST({qi(c)} AS DOUBLE)), 0)')} END AS kurtosis "
        f"FROM {source}" for i, c in enumerate(cols))


register("shape_stats_part", shape_sql("part", ["p_size", "p_retailprice"]))(
    lambda spark, sf: _round_cols(st.shape_stats(table(spark, sf, "part"), ["p_size", "p_retailprice"]),
                                  ["skewness", "kurtosis"]))


def missing_sql(source, cols):
    return "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", CAST(count(*) - count({qi(c)}) AS BIGINT) AS missing_count, "
        f"CASE WHEN count(*) > 0 THEN {srnd(f'(count(*) - count({qi(c)})) * 100.0 / count(*)', 2)} ELSE 0 END AS missing_percent "
        f"FROM {source}" for i, c in enumerate(cols))


_EV = [c for c, _ in TABLES["events"]]
register("missing_profile_events_missing", with_views("events_missing") + "\n" + missing_sql("events_missing", _EV))(
    lambda spark, sf: st.missing_profile(dv.events_missing(spark, sf)))
register("missing_profile_events_blank",
         with_views("events_blank") + "\n" + missing_sql("events_blank", ["event_id", "ts", "user_id", "event_type", "props"]))(
    lambda spark, sf: st.missing_profile(dv.events_blank(spark, sf)))
register("high_missing_events_mostly_null",
         with_views("events_mostly_null") + "\nSELECT * FROM (" + missing_sql("events_mostly_null", _EV)
         + ") WHERE missing_percent > 50")(
    lambda spark, sf: st.high_missing_report(dv.events_mostly_null(spark, sf)))


def value_counts_sql(source, cols, top=None):
    parts = [f"SELECT {i} AS position, '{c}' AS \"column\", CAST({qi(c)} AS VARCHAR) AS value FROM {source}"
             for i, c in enumerate(cols)]
    lim = f" WHERE rank <= {top}" if top else ""
    return f"""SELECT * FROM (
SELECT position, "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank
FROM (SELECT position, "column", coalesce(value, 'NoData') AS value, CAST(count(*) AS BIGINT) AS count
      FROM ({' UNION ALL '.join(parts)}) WHERE value IS NULL OR lower(trim(value)) <> 'nan'
      GROUP BY ALL)){lim}"""


register("value_counts_lineitem", value_counts_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber"]))(
    lambda spark, sf: st.value_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))
register("value_counts_part_top30", value_counts_sql("part", ["p_name", "p_brand", "p_type"], top=30))(
    lambda spark, sf: st.value_counts(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], top=30))
register("value_counts_events_missing", with_views("events_missing") + "\n" + value_counts_sql("events_missing", ["event_type", "props"]))(
    lambda spark, sf: st.value_counts(dv.events_missing(spark, sf), ["event_type", "props"]))
register("value_counts_events_numtext", with_views("events_numtext") + "\n" + value_counts_sql("events_numtext", ["value_text"], top=50))(
    lambda spark, sf: st.value_counts(dv.events_numtext(spark, sf), ["value_text"], top=50))


def _dt_sql(source, cols):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min_date, "
        f"strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS max_date, "
        f"CAST(count(DISTINCT date_trunc('month', {c})) AS BIGINT) AS months FROM {source}" for c in cols)


register("datetime_profile_events", _dt_sql("events", ["ts"]))(
    lambda spark, sf: st.datetime_profile(table(spark, sf, "events"), ["ts"]))
register("datetime_profile_orders_lineitem",
         _dt_sql("orders", ["o_orderdate"]) + "\nUNION ALL\n" + _dt_sql("lineitem", ["l_shipdate"]))(
    lambda spark, sf: st.datetime_profile(table(spark, sf, "orders"), ["o_orderdate"]).unionByName(
        st.datetime_profile(table(spark, sf, "lineitem"), ["l_shipdate"])))


def _monthly_sql(source, col, cap=20):
    guard = f" WHERE (SELECT count(DISTINCT date_trunc('month', {col})) FROM {source}) <= {cap}" if cap else ""
    return (f"SELECT strftime(date_trunc('month', {col}), '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS count "
            f"FROM {source} WHERE {col} IS NOT NULL AND TRUE{guard.replace(' WHERE', ' AND')} GROUP BY 1")


register("monthly_counts_events", _monthly_sql("events", "ts"))(
    lambda spark, sf: st.monthly_counts(table(spark, sf, "events"), "ts", max_months=20))
register("monthly_counts_orders_capped", _monthly_sql("orders", "o_orderdate"))(
    lambda spark, sf: st.monthly_counts(table(spark, sf, "orders"), "o_orderdate", max_months=20))
register("monthly_counts_orders_all", _monthly_sql("orders", "o_orderdate", cap=None))(
    lambda spark, sf: st.monthly_counts(table(spark, sf, "orders"), "o_orderdate", max_months=None))

register("last_per_entity_events",
         with_views("events_missing") + """
SELECT user_id, max_by(value, CASE WHEN value IS NOT NULL THEN event_id END) AS value
FROM events_missing WHERE user_id IS NOT NULL GROUP BY user_id""")(
    lambda spark, sf: st.last_per_entity(dv.events_missing(spark, sf), "user_id", "value", "event_id"))


def _imb_sql(source, col):
    return f"""WITH c AS (SELECT {col} AS cls, count(*) AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY 1),
s AS (SELECT sum(n) AS total, count(*) AS classes, max(n) AS mx, min(n) AS mn FROM c)
SELECT '{col}' AS "column", CAST(total AS BIGINT) AS total, CAST(classes AS BIGINT) AS classes,
  {srnd('mx / total', 3)} AS majority_share,
  CASE WHEN classes <= 1 THEN 0.0 ELSE {srnd('mn / total', 3)} END AS minority_share,
  CASE WHEN classes <= 1 THEN 'inf'::DOUBLE ELSE {srnd('mx / greatest(1, mn)', 3)} END AS imbalance_ratio FROM s"""


register("imbalance_orders_status", _imb_sql("orders", "o_orderstatus"))(
    lambda spark, sf: st.imbalance_summary(table(spark, sf, "orders"), "o_orderstatus"))
register("imbalance_labels_quality", _imb_sql("labels", "quality"))(
    lambda spark, sf: st.imbalance_summary(table(spark, sf, "labels"), "quality"))
register("imbalance_events_missing_type", with_views("events_missing") + ",\n" + _imb_sql("events_missing", "event_type")[5:])(
    lambda spark, sf: st.imbalance_summary(dv.events_missing(spark, sf), "event_type"))
register("top_classes_customer_segment", """SELECT value, count, rank FROM (
  SELECT c_mktsegment AS value, CAST(count(*) AS BIGINT) AS count,
         row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS rank
  FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1) WHERE rank <= 10""")(
    lambda spark, sf: st.top_classes(table(spark, sf, "customer"), "c_mktsegment"))


def _dup_sql(source):
    return f"""SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS BIGINT) AS distinct_rows,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS BIGINT) AS duplicate_rows,
  CASE WHEN count(*) > 0 THEN {srnd(f'(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))) * 100.0 / count(*)', 2)} ELSE 0.0 END AS duplicate_percent
FROM {source}"""


register("duplicates_orders_dup", with_views("orders_dup") + "\n" + _dup_sql("orders_dup"))(
    lambda spark, sf: st.duplicate_summary(dv.orders_dup(spark, sf)))
register("duplicates_lineitem", _dup_sql("lineitem"))(
    lambda spark, sf: st.duplicate_summary(table(spark, sf, "lineitem")))
register("duplicates_events_blank", with_views("events_blank") + "\n" + _dup_sql("events_blank"))(
    lambda spark, sf: st.duplicate_summary(dv.events_blank(spark, sf)))

register("group_mean_lineitem_flag", f"""SELECT l_returnflag, {srnd('avg(l_quantity)')} AS mean_l_quantity,
  max(l_extendedprice) AS max_l_extendedprice, CAST(count(l_orderkey) AS BIGINT) AS count_l_orderkey
FROM lineitem GROUP BY l_returnflag""")(
    lambda spark, sf: _round_cols(st.group_aggregate(table(spark, sf, "lineitem"), ["l_returnflag"],
                                                     {"l_quantity": ["mean"], "l_extendedprice": ["max"],
                                                      "l_orderkey": ["count"]}), ["mean_l_quantity"]))
register("scalar_avg_events_value", f"SELECT {srnd('avg(value)')} AS result FROM events")(
    lambda spark, sf: _round_cols(st.scalar_result(table(spark, sf, "events"), "avg(value)"), ["result"]))
