"""Composed analyses (G9-G12, G15-G17, D9) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import quality as qa
from ..plans import analysis as an
from ..registry import register, table
from ..sources import derived as dv
from ._sql import TABLES, qi, rnd as srnd, roles_ctes, with_views
from .dist import BOX_VALUES, OUTLIER_VALUES, bars_sql, box_sql, corr_sql, dist_hist_sql, histogram_sql, outlier_sql, shares_sql
from .stats import missing_sql, numeric_stats_sql


def _r(df, cols, digits=4):
    return df.select(*[rnd(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def health_sql(source, cols, pre=""):
    """cols: [(name, kind)] of the source."""
    n = len(cols)
    miss = " + ".join(f"(count(*) - count({qi(c)}))" for c, _ in cols)
    high = " + ".join(f"(CASE WHEN count(*) > 0 AND (count(*) - count({qi(c)})) / count(*) > 0.5 THEN 1 ELSE 0 END)"
                      for c, _ in cols)
    sk = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({qi(c)}) AS k, skewness(CAST({qi(c)} AS DOUBLE)) AS g FROM {source}"
        for c, kind in cols if kind == "numeric")
    dist = f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {source}))"
    return f"""{pre}{'WITH' if not pre else ','} {roles_ctes(source, cols)},
sk AS ({sk}),
cons AS (SELECT CASE WHEN count(*) > 0 THEN avg(1 - least(1.0, abs(coalesce(g, 0)) / 10)) * 100 ELSE 100.0 END AS c
         FROM sk JOIN r ON sk."column" = r."column" WHERE r.is_numeric AND NOT r.is_key AND sk.k > 5),
base AS (SELECT greatest(0.0, 1 - ({miss}) / (count(*) * {n})) * 100 AS completeness,
                greatest(0.0, 1 - (count(*) - {dist}) / greatest(1, count(*))) * 100 AS uniqueness,
                greatest(0.0, 1 - ({high}) / {max(1, n)}) * 100 AS validity FROM {source}),
s AS (SELECT completeness, uniqueness, cons.c AS consistency, validity,
             completeness * 0.40 + uniqueness * 0.25 + cons.c * 0.20 + validity * 0.15 AS overall FROM base, cons)
SELECT {srnd('completeness', 1)} AS completeness, {srnd('uniqueness', 1)} AS uniqueness,
       {srnd('consistency', 1)} AS consistency, {srnd('validity', 1)} AS validity, {srnd('overall', 1)} AS overall,
       CASE WHEN overall >= 90 THEN 'Excellent' WHEN overall >= 75 THEN 'Good' WHEN overall >= 60 THEN 'Fair'
            ELSE 'Poor' END AS grade FROM s"""


register("health_score_events_missing",
         health_sql("events_missing", TABLES["events"], with_views("events_missing").replace("WITH", "WITH", 1)))(
    lambda spark, sf: qa.health_score(dv.events_missing(spark, sf)))
register("health_score_orders_dup", health_sql("orders_dup", TABLES["orders"], with_views("orders_dup")))(
    lambda spark, sf: qa.health_score(dv.orders_dup(spark, sf)))
register("health_score_lineitem_const",
         health_sql("lineitem_const", TABLES["lineitem"] + [("c_const", "numeric")], with_views("lineitem_const")))(
    lambda spark, sf: qa.health_score(dv.lineitem_const(spark, sf)))
register("health_score_events_mostly_null", health_sql("events_mostly_null", TABLES["events"], with_views("events_mostly_null")))(
    lambda spark, sf: qa.health_score(dv.events_mostly_null(spark, sf)))


def insights_sql(source, cols, numeric_n, text_n, pre=""):
    high = " UNION ALL ".join(
        f"SELECT {i} AS p, '{c}' AS c, (count(*) - count({qi(c)})) * 100.0 / count(*) AS m FROM {source}"
        for i, c in enumerate(cols))
    lines = [f"SELECT 0 AS line, 'Dataset contains ' || format('{{:,}}', count(*)) || ' rows and {len(cols)} columns' AS text FROM {source}"]
    k = 1
    if numeric_n:
        lines.append(f"SELECT {k}, 'Found {numeric_n} numeric columns for quantitative analysis'")
        k += 1
    if text_n:
        lines.append(f"SELECT {k}, 'Found {text_n} categorical columns for classification'")
        k += 1
    lines.append(f"SELECT {k}, 'Columns with significant missing data: ' || string_agg(c, ', ' ORDER BY p) "
                 f"FROM ({high}) WHERE m > 10 HAVING count(*) > 0")
    return pre + "\n" + "\nUNION ALL\n".join(lines)


register("basic_insights_events_missing",
         insights_sql("events_missing", [c for c, _ in TABLES["events"]], 3, 2, with_views("events_missing")))(
    lambda spark, sf: qa.basic_insights(dv.events_missing(spark, sf)).withColumn("line", F.col("line").cast("int")))
register("basic_insights_lineitem", insights_sql("lineitem", [c for c, _ in TABLES["lineitem"]], 8, 2))(
    lambda spark, sf: qa.basic_insights(table(spark, sf, "lineitem")).withColumn("line", F.col("line").cast("int")))


_LI_NUM = [c for c, k in TABLES["lineitem"] if k == "numeric"]
_MET = ["count", "missing", "mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]


def _profile_long_sql():
    num = numeric_stats_sql("lineitem", _LI_NUM)
    miss = missing_sql("lineitem", [c for c, _ in TABLES["lineitem"]])
    num_u = " UNION ALL ".join(f"SELECT 'numeric' AS section, \"column\", '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM n"
                               for m in _MET)
    return f"""WITH n AS ({num}), m AS ({miss}),
d AS (SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS dr FROM lineitem)
SELECT section, "column", metric, {srnd('value')} AS value FROM (
  {num_u}
  UNION ALL SELECT 'missing', "column", 'missing_count', CAST(missing_count AS DOUBLE) FROM m
  UNION ALL SELECT 'missing', "column", 'missing_percent', missing_percent FROM m
  UNION ALL SELECT 'duplicates', '*', 'duplicate_rows', CAST(rows - dr AS DOUBLE) FROM d
  UNION ALL SELECT 'duplicates', '*', 'duplicate_percent', {srnd('(rows - dr) * 100.0 / rows', 2)} FROM d)"""


register("profile_long_lineitem", _profile_long_sql())(
    lambda spark, sf: _r(an.profile_long(table(spark, sf, "lineitem")), ["value"]))


register("profile_json_events_missing", with_views("events_missing") + f""",
m AS ({missing_sql('events_missing', [c for c, _ in TABLES['events']])}),
v AS (SELECT 'event_type' AS col, 0 AS pos, event_type AS v FROM events_missing UNION ALL SELECT 'props', 1, props FROM events_missing),
c AS (SELECT pos, col, coalesce(v, 'NoData') AS v, count(*) AS n FROM v WHERE v IS NULL OR lower(trim(v)) <> 'nan' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, v) AS rank FROM c),
d AS (SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM events_missing)) AS dr FROM events_missing)
SELECT 'missing' AS section, CAST(to_json({{'position': position, 'column': "column", 'missing_count': missing_count,
  'missing_percent': CAST(missing_percent AS DOUBLE)}}) AS VARCHAR) AS payload FROM m
UNION ALL SELECT 'duplicates', CAST(to_json({{'rows': rows, 'distinct_rows': dr, 'duplicate_rows': rows - dr,
  'duplicate_percent': CAST({srnd('(rows - dr) * 100.0 / rows', 2)} AS DOUBLE)}}) AS VARCHAR) FROM d
UNION ALL SELECT 'value_counts', CAST(to_json({{'column': col, 'position': pos, 'value': v, 'count': n, 'rank': rank}}) AS VARCHAR) FROM r""")(
    lambda spark, sf: an.profile_json(dv.events_missing(spark, sf), sections=["missing", "duplicates", "value_counts"]))


register("profile_summary_orders", f"""WITH {roles_ctes('orders', TABLES['orders'])}
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns, CAST(count(*) AS BIGINT) AS sampled_rows,
  (SELECT string_agg("column", ', ' ORDER BY position) FROM r WHERE is_key) AS primary_keys, 1.0 AS sample_ratio FROM orders""")(
    lambda spark, sf: an.profile_summary(table(spark, sf, "orders"))["summary"])
register("profile_top_missing_events", with_views("events_missing") + "\nSELECT \"column\", missing_percent FROM ("
         + missing_sql("events_missing", [c for c, _ in TABLES["events"]]) + ") ORDER BY missing_percent DESC, position LIMIT 8")(
    lambda spark, sf: an.profile_summary(dv.events_missing(spark, sf), top_missing=8)["top_missing"])
register("profile_imbalance_lineitem", f"""WITH {roles_ctes('lineitem', TABLES['lineitem'])},
cand AS (SELECT "column", position FROM r WHERE NOT is_key AND is_categorical AND distinct_count BETWEEN 2 AND 20
         ORDER BY position LIMIT 5),
v AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS cls FROM lineitem" for c, _ in TABLES['lineitem'])}),
c AS (SELECT col, cls, count(*) AS n FROM v WHERE cls IS NOT NULL AND col IN (SELECT "column" FROM cand) GROUP BY 1, 2),
s AS (SELECT col, sum(n) AS total, count(*) AS classes, max(n) AS mx, min(n) AS mn FROM c GROUP BY 1)
SELECT col AS "column", CAST(total AS BIGINT) AS total, CAST(classes AS BIGINT) AS classes,
  {srnd('mx / total', 3)} AS majority_share, CASE WHEN classes <= 1 THEN 0.0 ELSE {srnd('mn / total', 3)} END AS minority_share,
  CASE WHEN classes <= 1 THEN 'inf'::DOUBLE ELSE {srnd('mx / greatest(1, mn)', 3)} END AS imbalance_ratio FROM s""")(
    lambda spark, sf: an.profile_summary(table(spark, sf, "lineitem"), n_candidates=10, n_imbalance=5)["imbalance"])


register("column_details_orders_status_info", f"""SELECT 'o_orderstatus' AS name, CAST(count(*) AS BIGINT) AS total_count,
  CAST(count(*) - count(o_orderstatus) AS BIGINT) AS null_count,
  {srnd('(count(*) - count(o_orderstatus)) * 100.0 / count(*)', 2)} AS null_percentage,
  CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS unique_count, false AS is_numeric,
  count(DISTINCT o_orderstatus) / count(*) <= 0.95 AS is_categorical, false AS is_primary_key FROM orders""")(
    lambda spark, sf: an.column_details(table(spark, sf, "orders"), "o_orderstatus")["info"])
register("column_details_orders_status_top", f"""SELECT value, count, rank, {srnd('count * 100.0 / t', 2)} AS percentage FROM (
  SELECT o_orderstatus AS value, CAST(count(*) AS BIGINT) AS count, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS rank,
         (SELECT count(*) FROM orders) AS t FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1) WHERE rank <= 50""")(
    lambda spark, sf: an.column_details(table(spark, sf, "orders"), "o_orderstatus")["top_values"])
register("column_details_quantity_stats", f"""SELECT {srnd('avg(l_quantity)')} AS mean, {srnd('quantile_cont(l_quantity, 0.5)')} AS median,
  {srnd('stddev_samp(l_quantity)')} AS std, {srnd('min(l_quantity)')} AS min, {srnd('max(l_quantity)')} AS max,
  {srnd('quantile_cont(l_quantity, 0.25)')} AS q25, {srnd('quantile_cont(l_quantity, 0.75)')} AS q75 FROM lineitem""")(
    lambda spark, sf: _r(an.column_details(table(spark, sf, "lineitem"), "l_quantity")["statistics"],
                         ["mean", "median", "std", "min", "max", "q25", "q75"]))


def _guarded(source, cols, rule, sql_fn):
    """One SQL block per candidate column, kept only when the role rule holds."""
    return "\nUNION ALL\n".join(
        f"SELECT * FROM ({sql_fn(source, c)}) WHERE EXISTS (SELECT 1 FROM r WHERE \"column\" = '{c}' AND {rule})"
        for c in cols)


_NUM_RULE = "is_numeric AND is_sensible AND NOT is_key"
register("numerical_analysis_events_stats",
         with_views("events_missing") + f",\n{roles_ctes('events_missing', TABLES['events'])}\n"
         + _guarded("events_missing", ["event_id", "user_id", "value"], _NUM_RULE,
                    lambda s, c: numeric_stats_sql(s, [c]).replace("SELECT 0 AS position", f"SELECT {['event_id', 'user_id', 'value'].index(c)} AS position")))(
    lambda spark, sf: _r(_num_stats(spark, sf), ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]))


def _num_stats(spark, sf):
    st = an.numerical_analysis(dv.events_missing(spark, sf))["statistics"]
    pos = {"event_id": 0, "user_id": 1, "value": 2}
    m = F.create_map(*[x for k, v in pos.items() for x in (F.lit(k), F.lit(v))])
    return st.withColumn("position", m[F.col("column")])


register("numerical_analysis_dedup_stats",
         with_views("events_missing") + f""",
d AS (SELECT user_id, max_by(value, CASE WHEN value IS NOT NULL THEN event_id END) AS value FROM events_missing
      WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT * EXCLUDE (position) FROM ({numeric_stats_sql('d', ['value'])})""")(
    lambda spark, sf: _r(an.numerical_analysis(dv.events_missing(spark, sf), entity="user_id", order="event_id")
                         ["statistics"].filter(F.col("column") == "value").drop("position"),
                         ["mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"]))

_EV_NUM = ["event_id", "user_id", "value"]
_EV_ROLES = with_views("events_missing") + f",\n{roles_ctes('events_missing', TABLES['events'])}\n"
register("numerical_analysis_events_outliers",
         _EV_ROLES + _guarded("events_missing", _EV_NUM, _NUM_RULE, lambda s, c: outlier_sql(s, [c], 1)))(
    lambda spark, sf: _r(an.numerical_analysis(dv.events_missing(spark, sf))["outliers"], OUTLIER_VALUES))
register("numerical_analysis_events_distribution",
         _EV_ROLES + _guarded("events_missing", _EV_NUM, _NUM_RULE, dist_hist_sql))(
    lambda spark, sf: _r(an.numerical_analysis(dv.events_missing(spark, sf))["distribution"], ["lower", "upper"]))
register("numerical_analysis_events_box",
         _EV_ROLES + _guarded("events_missing", _EV_NUM, _NUM_RULE, lambda s, c: box_sql(s, [c])))(
    lambda spark, sf: _r(an.numerical_analysis(dv.events_missing(spark, sf))["box"], BOX_VALUES))

_CAT_RULE = "is_categorical AND NOT is_key AND NOT is_numeric AND distinct_count >= 2"
register("categorical_analysis_orders_bars",
         f"WITH {roles_ctes('orders', TABLES['orders'])}\n"
         + _guarded("orders", [c for c, _ in TABLES["orders"]], _CAT_RULE,
                    lambda s, c: f"SELECT '{c}' AS \"column\", * FROM ({bars_sql(s, c)})"))(
    lambda spark, sf: an.categorical_analysis(table(spark, sf, "orders"))["bars"])

register("categorical_analysis_orders_shares",
         f"WITH {roles_ctes('orders', TABLES['orders'])}\n"
         + _guarded("orders", [c for c, _ in TABLES["orders"]], _CAT_RULE,
                    lambda s, c: f"SELECT '{c}' AS \"column\", * FROM ({shares_sql('', s, c)})"))(
    lambda spark, sf: an.categorical_analysis(table(spark, sf, "orders"))["shares"])

register("report_histograms_lineitem", "WITH " + histogram_sql("lineitem", _LI_NUM))(
    lambda spark, sf: _r(an.report_tables(table(spark, sf, "lineitem"), n_numeric=8)["histograms"], ["lower", "upper"]))
register("report_top_values_lineitem", """SELECT position, "column", value, count, rank FROM (
  SELECT position, "column", value, count, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM (
    SELECT 0 AS position, 'l_returnflag' AS "column", l_returnflag AS value, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 3
    UNION ALL SELECT 1, 'l_linestatus', l_linestatus, CAST(count(*) AS BIGINT) FROM lineitem GROUP BY 3)) WHERE rank <= 12""")(
    lambda spark, sf: an.report_tables(table(spark, sf, "lineitem"), n_categorical=8, top=12)["top_values"])
register("report_correlation_lineitem", corr_sql("lineitem", _LI_NUM, fill=True))(
    lambda spark, sf: _r(an.report_tables(table(spark, sf, "lineitem"))["correlation"], ["corr"]))
