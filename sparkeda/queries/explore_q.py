"""Explore (F1-F11), ad-hoc (Q1-Q3) and time-series (W1-W6) queries with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import adhoc as ad
from ..operators import explore as ex
from ..operators import timeseries as tsr
from ..registry import register, table
from ..session import spread
from ..sources import derived as dv
from ._sql import TABLES, roles_ctes, rnd as srnd, with_views

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
_OCOLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*_OCOLS)


register("filter_range_lineitem",
         "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")(
    lambda spark, sf: ex.apply_filters(table(spark, sf, "lineitem"), {"l_quantity": {"min": 10, "max": 20}})
    .select("l_orderkey", "l_linenumber", "l_quantity"))
register("filter_range_events_numtext",
         with_views("events_numtext") + """
SELECT * FROM events_numtext WHERE regexp_full_match(value_text, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
  AND TRY_CAST(trim(value_text) AS DOUBLE) >= 10 AND TRY_CAST(trim(value_text) AS DOUBLE) <= 50""")(
    lambda spark, sf: ex.apply_filters(dv.events_numtext(spark, sf), {"value_text": {"min": 10, "max": 50}}))
register("filter_combined_orders",
         f"SELECT {_O} FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 1000 "
         "AND o_orderpriority = '1-URGENT'")(
    lambda spark, sf: ex.apply_filters(_orders(spark, sf), {
        "o_orderstatus": ["F", "P"], "o_totalprice": {"min": 1000}, "o_orderpriority": "1-URGENT",
        "not_a_column": 3, "o_custkey": []}))


def _page_sql(src, cols, sort, page, size, pre=""):
    page, size = max(1, page), min(500, max(10, size))
    start = (page - 1) * size
    return (f"{pre}SELECT {cols} FROM (SELECT *, row_number() OVER (ORDER BY {sort}) - 1 AS rn FROM {src}) "
            f"WHERE rn >= {start} AND rn < {start + size}")


def _meta_sql(src, page, size, pre=""):
    page, size = max(1, page), min(500, max(10, size))
    start = (page - 1) * size
    return (f"{pre}SELECT {page} AS page, {size} AS page_size, CAST(count(*) AS BIGINT) AS total_rows, "
            f"CAST((count(*) + {size} - 1) // {size} AS BIGINT) AS total_pages, {start + size} < count(*) AS has_next, "
            f"{'true' if page > 1 else 'false'} AS has_prev FROM {src}")


_OSORT = "o_totalprice DESC NULLS LAST, " + ", ".join(f"{c} ASC NULLS LAST" for c in _OCOLS)
register("paginate_orders_rows", _page_sql("orders", _O, _OSORT, 3, 20))(
    lambda spark, sf: ex.paginate(_orders(spark, sf), 3, 20, "o_totalprice", "desc")[0])
register("paginate_orders_meta", _meta_sql("orders", 3, 20))(
    lambda spark, sf: ex.paginate(_orders(spark, sf), 3, 20, "o_totalprice", "desc")[1])
register("paginate_orders_clamped", _page_sql("orders", _O, _OSORT, 1, 5))(
    lambda spark, sf: ex.paginate(_orders(spark, sf), 0, 5, "o_totalprice", "desc")[0])
register("paginate_orders_past_end", _page_sql("orders", _O, _OSORT, 100000, 1000))(
    lambda spark, sf: ex.paginate(_orders(spark, sf), 100000, 1000, "o_totalprice", "desc")[0])
_EM = ["event_id", "user_id", "event_type", "value"]
register("paginate_events_missing_last",
         _page_sql("events_missing", "event_id, user_id, event_type, value",
                   "value ASC NULLS LAST, event_id, user_id, event_type, value", 20, 500,
                   with_views("events_missing") + "\n"))(
    lambda spark, sf: ex.paginate(dv.events_missing(spark, sf).select(*_EM), 20, 500, "value", "asc")[0])
register("paginate_events_missing_meta", _meta_sql("events_missing", 20, 500, with_views("events_missing") + "\n"))(
    lambda spark, sf: ex.paginate(dv.events_missing(spark, sf).select(*_EM), 20, 500, "value", "asc")[1])

register("explore_info_orders",
         f"""WITH src AS (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'O')),
{roles_ctes('src', TABLES['orders'])}
SELECT position, "column" AS name, is_numeric, is_categorical, distinct_count AS unique_count, nulls AS null_count,
  CASE WHEN is_numeric THEN num_min END AS min, CASE WHEN is_numeric THEN num_max END AS max FROM r""")(
    lambda spark, sf: ex.explore_column_info(
        ex.apply_filters(table(spark, sf, "orders"), {"o_orderstatus": ["F", "O"]}))[0])
register("explore_top_values_orders", """SELECT "column", value, count, rank FROM (
  SELECT "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM (
    SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, CAST(count(*) AS BIGINT) AS count FROM orders
      WHERE o_orderstatus IN ('F', 'O') GROUP BY 2
    UNION ALL
    SELECT 'o_orderpriority', o_orderpriority, CAST(count(*) AS BIGINT) FROM orders
      WHERE o_orderstatus IN ('F', 'O') GROUP BY 2)) WHERE rank <= 20""")(
    lambda spark, sf: ex.explore_column_info(
        ex.apply_filters(table(spark, sf, "orders"), {"o_orderstatus": ["F", "O"]}))[1])


@register("explore_page_orders", _page_sql("(SELECT * FROM orders WHERE o_totalprice >= 100000)",
                                           ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _OCOLS),
                                           _OSORT, 2, 25))
def _explore_page(spark, sf):
    out = ex.explore(_orders(spark, sf), {"o_totalprice": {"min": 100000}}, "o_totalprice", "desc", 2, 25)
    return out["data"]


register("top_n_lineitem", """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10""")(
    lambda spark, sf: ex.top_n(table(spark, sf, "lineitem"), "l_extendedprice", 10, ["l_orderkey", "l_linenumber"])
    .select("l_orderkey", "l_linenumber", "l_extendedprice"))
register("select_drop_null_events", with_views("events_missing") + """
SELECT event_id, event_type, value FROM events_missing WHERE value IS NOT NULL AND event_type IS NOT NULL""")(
    lambda spark, sf: ex.drop_null_rows(ex.select_columns(dv.events_missing(spark, sf), ["event_id", "event_type", "value"]),
                                        ["value", "event_type"]))

_SQL_Q = ("SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS sum_cust, max(o_totalprice) AS max_price "
          "FROM dataset GROUP BY o_orderstatus;")
register("run_sql_orders", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS sum_cust, "
         "max(o_totalprice) AS max_price FROM orders GROUP BY o_orderstatus")(
    lambda spark, sf: ad.run_sql(table(spark, sf, "orders"), _SQL_Q, 1, 10)[0])
register("run_sql_ordered_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 100")(
    lambda spark, sf: ad.run_sql(table(spark, sf, "orders"),
                                 "SELECT o_orderkey, o_totalprice FROM dataset ORDER BY o_totalprice DESC, o_orderkey", 2, 100)[0])
register("run_sql_join_lineitem", """SELECT o.o_orderpriority, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(sum(l.l_quantity) AS DOUBLE) AS qty FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1""")(
    lambda spark, sf: _join_sql(spark, sf))


def _join_sql(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_v")
    rows, _ = ad.run_sql(table(spark, sf, "lineitem"),
                         "SELECT o.o_orderpriority, count(*) AS n_lines, CAST(sum(l.l_quantity) AS DOUBLE) AS qty "
                         "FROM dataset l JOIN orders_v o ON l.l_orderkey = o.o_orderkey GROUP BY 1", 1, 10)
    return rows


register("query_spec_lineitem", f"""SELECT l_returnflag, {srnd('avg(l_quantity)')} AS mean_l_quantity,
  CAST(count(l_orderkey) AS BIGINT) AS count_l_orderkey FROM lineitem WHERE l_discount >= 0.05
GROUP BY l_returnflag ORDER BY count_l_orderkey DESC LIMIT 2""")(
    lambda spark, sf: _spec(spark, sf))


def _spec(spark, sf):
    out = ad.run_query_spec(table(spark, sf, "lineitem"), {
        "filters": {"l_discount": {"min": 0.05}}, "group_by": ["l_returnflag"],
        "aggs": {"l_quantity": ["mean"], "l_orderkey": ["count"]}, "sort_by": "count_l_orderkey",
        "sort_order": "desc", "limit": 2})
    return out.withColumn("mean_l_quantity", rnd(F.col("mean_l_quantity")))


register("match_vocabulary_typos", with_views("typos") + f""",
c AS (SELECT t.name AS value, n.n_name AS entry,
        1.0 - levenshtein(t.name, n.n_name) / greatest(length(t.name), length(n.n_name)) AS score,
        lower(t.name) = lower(n.n_name) AS exact
      FROM (SELECT DISTINCT name FROM typos) t, nation n),
b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY exact DESC, score DESC, entry) AS r
      FROM c WHERE exact OR score >= 0.7)
SELECT v.value, coalesce(b.entry, v.value) AS match, CASE WHEN b.exact THEN 1.0 ELSE {srnd('b.score')} END AS score
FROM (SELECT DISTINCT name AS value FROM typos) v LEFT JOIN b ON v.value = b.value AND b.r = 1""")(
    lambda spark, sf: _match(spark, sf))


def _match(spark, sf):
    m = ad.match_to_vocabulary(dv.typos(spark, sf), "name", table(spark, sf, "nation"), "n_name")
    return m.withColumn("score", rnd(F.col("score")))


# ---- time series ----
register("series_view_events", """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value, key FROM (
  SELECT ts, value, event_id AS key FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)
WHERE (SELECT count(*) FROM events WHERE value IS NOT NULL) >= 10""")(
    lambda spark, sf: tsr.series_view(table(spark, sf, "events"), "ts", "value", "event_id").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value", "key"))


def _ma_sql(src, ts, val, key, pre=""):
    return f"""{pre}SELECT * FROM (
WITH b AS (SELECT {ts} AS ts, CAST({val} AS DOUBLE) AS value, {key} AS key FROM {src} WHERE {ts} IS NOT NULL AND {val} IS NOT NULL),
n AS (SELECT count(*) AS n FROM b),
p AS (SELECT least(7, n // 3) AS w, (least(7, n // 3) - 1) // 2 AS off FROM n WHERE n > 7),
i AS (SELECT *, row_number() OVER (ORDER BY ts, key) - 1 AS idx FROM b)
SELECT i.key, i.idx, (SELECT CASE WHEN count(*) = p.w THEN {srnd('sum(j.value) / p.w')} END
         FROM i j WHERE j.idx BETWEEN i.idx - (p.w - 1 - p.off) AND i.idx + p.off) AS trend
FROM i, p)"""


register("moving_average_events_missing",
         with_views("events_missing") + f"""
SELECT key, CAST(idx AS BIGINT) AS idx, {srnd('CASE WHEN cnt = 7 THEN s / 7 END')} AS trend FROM (
  SELECT event_id AS key, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx,
         sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s,
         count(*) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS cnt
  FROM events_missing WHERE value IS NOT NULL AND ts IS NOT NULL)""")(
    lambda spark, sf: tsr.centered_moving_average(dv.events_missing(spark, sf), "ts", "value", "event_id")
    .select("key", "idx", rnd(F.col("trend")).alias("trend")))

register("moving_average_per_status", f"""
SELECT o_orderstatus, key, CASE WHEN n > 7 AND cnt = w THEN {srnd('s / w')} END AS trend FROM (
  SELECT o_orderstatus, o_orderkey AS key, n, w,
    CASE w WHEN 7 THEN sum(v) OVER w7 WHEN 6 THEN sum(v) OVER w6 WHEN 5 THEN sum(v) OVER w5
           WHEN 4 THEN sum(v) OVER w4 WHEN 3 THEN sum(v) OVER w3 ELSE sum(v) OVER w2 END AS s,
    CASE w WHEN 7 THEN count(v) OVER w7 WHEN 6 THEN count(v) OVER w6 WHEN 5 THEN count(v) OVER w5
           WHEN 4 THEN count(v) OVER w4 WHEN 3 THEN count(v) OVER w3 ELSE count(v) OVER w2 END AS cnt
  FROM (SELECT *, CAST(o_totalprice AS DOUBLE) AS v, count(*) OVER (PARTITION BY o_orderstatus) AS n,
               least(7, count(*) OVER (PARTITION BY o_orderstatus) // 3) AS w FROM orders)
  WINDOW w7 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
         w6 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING),
         w5 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
         w4 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING),
         w3 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),
         w2 AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING))""")(
    lambda spark, sf: tsr.centered_moving_average(table(spark, sf, "orders"), "o_orderdate", "o_totalprice",
                                                  "o_orderkey", partition_by=["o_orderstatus"])
    .select("o_orderstatus", "key", rnd(F.col("trend")).alias("trend")))


def _stats_sql(src, pairs, key, pre=""):
    parts = []
    for t, v in pairs:
        both = f"{t} IS NOT NULL AND {v} IS NOT NULL"
        parts.append(f"""SELECT '{t}' AS date_column, '{v}' AS value_column, CAST(count(*) AS BIGINT) AS points,
  strftime(min({t}), '%Y-%m-%d %H:%M:%S') AS start_date, strftime(max({t}), '%Y-%m-%d %H:%M:%S') AS end_date,
  {srnd(f'avg(CAST({v} AS DOUBLE))')} AS mean, {srnd(f'stddev_samp(CAST({v} AS DOUBLE))')} AS std,
  CASE WHEN max_by({v}, ({t}, {key})) > min_by({v}, ({t}, {key})) THEN 'increasing' ELSE 'decreasing' END AS trend_direction
FROM {src} WHERE {both} HAVING count(*) >= 10 AND count(DISTINCT {t}) >= 3""")
    return pre + "\nUNION ALL\n".join(parts)


def _stats_q(src, pairs, key):
    def run(spark, sf):
        out = tsr.series_stats(src(spark, sf), pairs, key)
        return out.withColumn("mean", rnd(F.col("mean"))).withColumn("std", rnd(F.col("std")))
    return run


register("series_stats_orders", _stats_sql("orders", [("o_orderdate", "o_totalprice"), ("o_orderdate", "o_custkey")], "o_orderkey"))(
    _stats_q(lambda s, f: table(s, f, "orders"), [("o_orderdate", "o_totalprice"), ("o_orderdate", "o_custkey")], "o_orderkey"))
register("timeseries_events_missing",
         _stats_sql("events_missing", [("ts", "value"), ("ts", "user_id")], "event_id", with_views("events_missing") + "\n"))(
    lambda spark, sf: tsr.timeseries(dv.events_missing(spark, sf), "event_id", ["ts"], ["value", "user_id"])
    .withColumn("mean", rnd(F.col("mean"))).withColumn("std", rnd(F.col("std"))))
register("trend_direction_lineitem", """SELECT 'l_shipdate' AS date_column, 'l_quantity' AS value_column,
  CASE WHEN max_by(l_quantity, (l_shipdate, l_orderkey)) > min_by(l_quantity, (l_shipdate, l_orderkey))
       THEN 'increasing' ELSE 'decreasing' END AS trend_direction FROM lineitem""")(
    lambda spark, sf: tsr.trend_direction(table(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "l_orderkey"))


register("match_ratio_typos")(
    lambda spark, sf: ad.match_by_ratio(dv.typos(spark, sf), "name", table(spark, sf, "nation"), "n_name")
    .withColumn("score", rnd(F.col("score"))))


def _words(spark, sf, name):
    """Lower-cased words of a text table (split on all that is no letter of any script)."""
    t = spread(table(spark, sf, name).select("text"))
    w = t.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).filter(F.length("w") > 0)
    return w.select(F.lower("w").alias("word"))


_WORDS_SQL = """(SELECT DISTINCT lower(w) AS {alias} FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{{L}}]+')) AS w
                 FROM {table}) WHERE w <> '')"""

#: the twin's edit distance counts bytes: letters of two bytes stand as capitals, which no word has
_ONE_BYTE = "translate({}, 'ßäçèéêíñóöüàâîïôùûáúœëøåæ', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"

register("match_vocabulary_document_words", f"""
WITH v AS {_WORDS_SQL.format(alias="value", table="documents")},
e AS {_WORDS_SQL.format(alias="entry", table="benchmark")},
near AS (SELECT lv, le FROM (SELECT DISTINCT length(value) AS lv FROM v), (SELECT DISTINCT length(entry) AS le FROM e)
         WHERE abs(lv - le) <= 0.3 * greatest(lv, le) + 1e-9),
c AS (SELECT v.value, e.entry,
        1.0 - levenshtein({_ONE_BYTE.format("v.value")}, {_ONE_BYTE.format("e.entry")}) / greatest(length(v.value), length(e.entry)) AS score,
        lower(v.value) = lower(e.entry) AS exact
      FROM v JOIN near ON length(v.value) = near.lv JOIN e ON length(e.entry) = near.le),
b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY exact DESC, score DESC, entry) AS r
      FROM c WHERE exact OR score >= 0.7)
SELECT v.value, coalesce(b.entry, v.value) AS match, CASE WHEN b.exact THEN 1.0 ELSE {srnd('b.score')} END AS score
FROM v LEFT JOIN b ON v.value = b.value AND b.r = 1""")(
    lambda spark, sf: ad.match_to_vocabulary(_words(spark, sf, "documents"), "word",
                                             _words(spark, sf, "benchmark"), "word")
    .withColumn("score", rnd(F.col("score"))))
