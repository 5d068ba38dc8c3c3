"""Distribution, correlation, outlier and density queries with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import correlation as co
from ..operators import distribution as di
from ..operators import outliers as ou
from ..registry import register, table
from ..sources import derived as dv
from ._sql import qi, rnd as srnd, with_views


def _r(df, cols, digits=4):
    return df.select(*[rnd(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _vsrc(source, cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({qi(c)} AS DOUBLE) AS v FROM {source}" for c in cols)


def histogram_sql(source, cols, bins=10):
    return f"""v AS ({_vsrc(source, cols)}),
b0 AS (SELECT "column", min(v) AS a, max(v) AS z FROM v GROUP BY 1),
b AS (SELECT "column", CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi FROM b0 WHERE a IS NOT NULL),
c AS (SELECT v."column", CAST(least(floor((v.v - b.lo) / ((b.hi - b.lo) / {bins})), {bins - 1}) AS INTEGER) AS bin,
             count(*) AS n FROM v JOIN b ON v."column" = b."column" WHERE v.v IS NOT NULL GROUP BY 1, 2),
g AS (SELECT "column", lo, hi, CAST(range AS INTEGER) AS bin FROM b, range({bins}))
SELECT g."column", g.bin, {srnd(f'g.lo + g.bin * ((g.hi - g.lo) / {bins})')} AS lower,
       {srnd(f'g.lo + (g.bin + 1) * ((g.hi - g.lo) / {bins})')} AS upper, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g."column" = c."column" AND g.bin = c.bin
UNION ALL
SELECT "column", NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM v WHERE v IS NULL GROUP BY 1"""


def _hist_q(src, cols, bins=10):
    return lambda spark, sf: _r(di.histogram(src(spark, sf), cols, bins), ["lower", "upper"])


_LI = ["l_quantity", "l_discount", "l_extendedprice", "l_tax"]
register("histogram_lineitem", "WITH " + histogram_sql("lineitem", _LI))(
    _hist_q(lambda s, f: table(s, f, "lineitem"), _LI))
register("histogram_lineitem_const", with_views("lineitem_const") + ",\n" + histogram_sql("lineitem_const", ["c_const", "l_quantity"]))(
    _hist_q(dv.lineitem_const, ["c_const", "l_quantity"]))
register("histogram_events_missing", with_views("events_missing") + ",\n" + histogram_sql("events_missing", ["value", "user_id"]))(
    _hist_q(dv.events_missing, ["value", "user_id"]))


def dist_hist_sql(source, col):
    v = f"CAST({qi(col)} AS DOUBLE)"
    return f"""SELECT * FROM (
WITH s AS (SELECT count({v}) AS n, min({v}) AS a, max({v}) AS z, count(DISTINCT {v}) AS d,
                  count(CASE WHEN {v} % 1 <> 0 THEN 1 END) AS f FROM {source}),
mode AS (SELECT n > 0 AND f = 0 AND d <= 60 AS bars, CAST(least(50, greatest(10, floor(sqrt(n)))) AS INTEGER) AS bins,
                CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi FROM s),
bar AS (SELECT '{col}' AS "column", coalesce(CAST(CAST({v} AS BIGINT) AS VARCHAR), 'No Value') AS label,
               CAST(count(*) AS BIGINT) AS count FROM {source} GROUP BY 2),
c AS (SELECT CAST(least(floor(({v} - mode.lo) / ((mode.hi - mode.lo) / mode.bins)), mode.bins - 1) AS INTEGER) AS bin,
             count(*) AS n FROM {source}, mode WHERE {v} IS NOT NULL GROUP BY 1),
g AS (SELECT lo, hi, bins, CAST(range AS INTEGER) AS bin FROM mode, range(50) WHERE range < bins)
SELECT "column", label, CASE WHEN label <> 'No Value' THEN CAST(label AS DOUBLE) END AS lower,
       CASE WHEN label <> 'No Value' THEN CAST(label AS DOUBLE) END AS upper, count
FROM bar WHERE (SELECT bars FROM mode)
UNION ALL
SELECT '{col}', CAST(g.bin AS VARCHAR), {srnd('g.lo + g.bin * ((g.hi - g.lo) / g.bins)')},
       {srnd('g.lo + (g.bin + 1) * ((g.hi - g.lo) / g.bins)')}, CAST(coalesce(c.n, 0) AS BIGINT)
FROM g LEFT JOIN c ON g.bin = c.bin WHERE NOT (SELECT bars FROM mode) AND (SELECT n FROM s) > 0)"""


def _dh(src, cols):
    def run(spark, sf):
        out = di.distribution_histogram(src(spark, sf), cols)
        return out.select("column", "label", rnd(F.col("lower")).alias("lower"),
                          rnd(F.col("upper")).alias("upper"), "count")
    return run


register("distribution_hist_lineitem",
         "\nUNION ALL\n".join(dist_hist_sql("lineitem", c) for c in ["l_quantity", "l_extendedprice", "l_linenumber"]))(
    _dh(lambda s, f: table(s, f, "lineitem"), ["l_quantity", "l_extendedprice", "l_linenumber"]))
register("distribution_hist_events_missing",
         with_views("events_missing") + "\n" + "\nUNION ALL\n".join(dist_hist_sql("events_missing", c) for c in ["value", "user_id"]))(
    _dh(dv.events_missing, ["value", "user_id"]))


def bars_sql(source, col, k=30):
    c = f"CAST({qi(col)} AS VARCHAR)"
    return f"""SELECT * FROM (
WITH m AS (SELECT count(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 1 END) AS m FROM {source}),
t AS (SELECT {c} AS label, count(*) AS count FROM {source}
      WHERE {c} IS NOT NULL AND {c} <> '' AND lower({c}) <> 'nan' GROUP BY 1),
r AS (SELECT label, count, row_number() OVER (ORDER BY count DESC, label) AS rank FROM t)
SELECT label, CAST(count AS BIGINT) AS count, rank FROM r WHERE rank <= {k}
UNION ALL SELECT 'No Value', CAST(m AS BIGINT), {k + 1} FROM m WHERE m > 0)"""


register("category_bars_part_name", bars_sql("part", "p_name"))(
    lambda spark, sf: di.category_bars(table(spark, sf, "part"), "p_name"))
register("category_bars_events_missing", with_views("events_missing") + "\n" + bars_sql("events_missing", "event_type"))(
    lambda spark, sf: di.category_bars(dv.events_missing(spark, sf), "event_type"))
register("category_bars_events_blank", with_views("events_blank") + "\n" + bars_sql("events_blank", "event_type"))(
    lambda spark, sf: di.category_bars(dv.events_blank(spark, sf), "event_type"))


def shares_sql(pre, source, col):
    return f"""{pre}SELECT label, count, {srnd('count * 100.0 / t', 2)} AS percent FROM (
  SELECT *, count(*) OVER () AS nb, sum(count) OVER () AS t FROM ({bars_sql(source, col)})) WHERE nb > 1 AND nb <= 15"""


register("category_shares_events_missing", shares_sql(with_views("events_missing") + "\n", "events_missing", "event_type"))(
    lambda spark, sf: di.category_shares(dv.events_missing(spark, sf), "event_type"))
register("category_shares_orders_priority", shares_sql("", "orders", "o_orderpriority"))(
    lambda spark, sf: di.category_shares(table(spark, sf, "orders"), "o_orderpriority"))
register("category_shares_part_name", shares_sql("", "part", "p_name"))(
    lambda spark, sf: di.category_shares(table(spark, sf, "part"), "p_name"))


def density_sql(source, pairs, bins=20, min_rows=10):
    parts = []
    for i, (a, b) in enumerate(pairs):
        x, y = f"CAST({qi(a)} AS DOUBLE)", f"CAST({qi(b)} AS DOUBLE)"
        parts.append(f"""SELECT * FROM (
WITH p AS (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
s AS (SELECT count(*) AS n, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS x0,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS x1,
             CASE WHEN min(y) = max(y) THEN min(y) - 0.5 ELSE min(y) END AS y0,
             CASE WHEN min(y) = max(y) THEN max(y) + 0.5 ELSE max(y) END AS y1 FROM p),
c AS (SELECT CAST(least(floor((x - x0) / ((x1 - x0) / {bins})), {bins - 1}) AS INTEGER) AS x_bin,
             CAST(least(floor((y - y0) / ((y1 - y0) / {bins})), {bins - 1}) AS INTEGER) AS y_bin, count(*) AS n
      FROM p, s GROUP BY 1, 2),
g AS (SELECT CAST(a.range AS INTEGER) AS x_bin, CAST(b.range AS INTEGER) AS y_bin, s.* FROM range({bins}) a, range({bins}) b, s WHERE s.n >= {min_rows})
SELECT '{a}' AS x, '{b}' AS y, g.x_bin, g.y_bin, {srnd(f'x0 + g.x_bin * ((x1 - x0) / {bins})')} AS x_left,
       {srnd(f'y0 + g.y_bin * ((y1 - y0) / {bins})')} AS y_left, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.x_bin = c.x_bin AND g.y_bin = c.y_bin)""")
    return "\nUNION ALL\n".join(parts)


def _dens(src, cols=None, pairs=None):
    def run(spark, sf):
        df = src(spark, sf)
        out = di.density_2d(df, *pairs[0]) if pairs else di.density_pairs(df, cols)
        return _r(out, ["x_left", "y_left"])
    return run


register("density_2d_lineitem", density_sql("lineitem", [("l_quantity", "l_extendedprice")]))(
    _dens(lambda s, f: table(s, f, "lineitem"), pairs=[("l_quantity", "l_extendedprice")]))
_DP = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("density_pairs_lineitem",
         density_sql("lineitem", [(a, b) for i, a in enumerate(_DP[:5]) for b in _DP[i + 1:6]]))(
    _dens(lambda s, f: table(s, f, "lineitem"), cols=_DP))
register("density_2d_events_missing", with_views("events_missing") + "\n" + density_sql("events_missing", [("value", "user_id")]))(
    _dens(dv.events_missing, pairs=[("value", "user_id")]))


register("kde_lineitem_quantity", f"""WITH s AS (SELECT count(l_quantity) AS n, stddev_samp(l_quantity) AS sd,
   min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
p AS (SELECT range AS point, lo + range * ((hi - lo) / 199) AS x, sd * pow(n, -0.2) AS h, n FROM s, range(200))
SELECT 'l_quantity' AS "column", CAST(point AS INTEGER) AS point, {srnd('x')} AS x,
       {srnd('sum(exp(-0.5 * pow((x - l_quantity) / h, 2))) * (1.0 / (n * h * sqrt(2 * pi())))', 6)} AS density
FROM p, lineitem GROUP BY point, x, h, n""")(
    lambda spark, sf: _r(_r(di.kde_curve(table(spark, sf, "lineitem"), "l_quantity"), ["x"]), ["density"], 6))


def corr_sql(source, cols, fill=False):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = f"CAST({qi(a)} AS DOUBLE)", f"CAST({qi(b)} AS DOUBLE)"
            sx = f"stddev_samp({x}) FILTER (WHERE {y} IS NOT NULL)"
            sy = f"stddev_samp({y}) FILTER (WHERE {x} IS NOT NULL)"
            if a == b:
                r = f"CASE WHEN {sx} > 0 THEN 1.0 END"
            else:
                r = f"CASE WHEN {sx} * {sy} > 0 THEN covar_samp({x}, {y}) / ({sx} * {sy}) END"
            if fill:
                r = f"coalesce({r}, 0.0)"
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {srnd(r)} AS corr FROM {source}")
            if a != b:
                parts.append(f"SELECT '{b}' AS col1, '{a}' AS col2, {srnd(r)} AS corr FROM {source}")
    return "\nUNION ALL\n".join(parts)


_CO = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
register("correlation_lineitem", corr_sql("lineitem", _CO))(
    lambda spark, sf: _r(co.correlation_matrix(table(spark, sf, "lineitem"), _CO), ["corr"]))
register("correlation_lineitem_const", with_views("lineitem_const") + "\n" + corr_sql("lineitem_const", ["c_const", "l_quantity", "l_tax"]))(
    lambda spark, sf: _r(co.correlation_matrix(dv.lineitem_const(spark, sf), ["c_const", "l_quantity", "l_tax"]), ["corr"]))
register("correlation_events_missing", with_views("events_missing") + "\n" + corr_sql("events_missing", ["value", "user_id", "event_id"]))(
    lambda spark, sf: _r(co.correlation_matrix(dv.events_missing(spark, sf), ["value", "user_id", "event_id"]), ["corr"]))
register("usable_correlation_lineitem_const",
         with_views("lineitem_const") + "\n" + corr_sql("lineitem_const", ["l_quantity", "l_extendedprice", "l_tax"], fill=True))(
    lambda spark, sf: _r(co.usable_correlation(dv.lineitem_const(spark, sf), ["c_const", "l_quantity", "l_extendedprice", "l_tax"]), ["corr"]))


def strong_sql(source, cols, t=0.5):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            x, y = f"CAST({qi(a)} AS DOUBLE)", f"CAST({qi(b)} AS DOUBLE)"
            sx = f"stddev_samp({x}) FILTER (WHERE {y} IS NOT NULL)"
            sy = f"stddev_samp({y}) FILTER (WHERE {x} IS NOT NULL)"
            r = f"coalesce(CASE WHEN {sx} * {sy} > 0 THEN covar_samp({x}, {y}) / ({sx} * {sy}) END, 0.0)"
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {r} AS r FROM {source}")
    return (f"SELECT col1, col2, {srnd('r', 3)} AS correlation, CASE WHEN r > 0 THEN 'Strong Positive' "
            f"ELSE 'Strong Negative' END AS strength FROM ({' UNION ALL '.join(parts)}) WHERE abs(r) >= {t}")


_RELATED = ["l_quantity", "l_extendedprice", "net", "left_over", "rate", "l_tax"]
register("strong_correlations_lineitem_related",
         "WITH related AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, 50 - l_quantity AS left_over, "
         "l_extendedprice / l_quantity AS rate, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS l_tax FROM lineitem)\n"
         + strong_sql("related", _RELATED))(
    lambda spark, sf: co.strong_correlations(table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (50 - F.col("l_quantity")).alias("left_over"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("l_tax")), _RELATED))

register("strong_correlations_lineitem", strong_sql("lineitem", _CO))(
    lambda spark, sf: co.strong_correlations(table(spark, sf, "lineitem"), _CO))
register("strong_correlations_lineitem_low", strong_sql("lineitem", ["l_orderkey", "l_partkey", "l_extendedprice", "l_quantity"], 0.01))(
    lambda spark, sf: co.strong_correlations(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_extendedprice", "l_quantity"], 0.01))


def outlier_sql(source, cols, min_values=4):
    parts = []
    for c in cols:
        v = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""SELECT * FROM (
WITH s AS (SELECT count({v}) AS n, avg({v}) AS m, stddev_samp({v}) AS sd, min({v}) AS a, max({v}) AS z,
                  quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {source}),
o AS (SELECT count(CASE WHEN {v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS i,
             count(CASE WHEN sd > 0 AND abs(({v} - m) / sd) > 3 THEN 1 END) AS zc FROM {source}, s)
SELECT '{c}' AS "column", CAST(n AS BIGINT) AS total_values, CAST(i AS BIGINT) AS iqr_outliers,
  {srnd('i * 100.0 / n', 2)} AS iqr_percent, CAST(zc AS BIGINT) AS zscore_outliers, {srnd('zc * 100.0 / n', 2)} AS zscore_percent,
  {srnd('m')} AS mean, {srnd('sd')} AS std, {srnd('q1')} AS q1, {srnd('q3')} AS q3, {srnd('q3 - q1')} AS iqr,
  {srnd('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {srnd('q3 + 1.5 * (q3 - q1)')} AS upper_bound,
  {srnd('a')} AS min, {srnd('z')} AS max FROM s, o WHERE n >= {min_values})""")
    return "\nUNION ALL\n".join(parts)


OUTLIER_VALUES = ["mean", "std", "q1", "q3", "iqr", "lower_bound", "upper_bound", "min", "max"]
register("outlier_summary_lineitem_spike",
         with_views("lineitem_spike") + "\n" + outlier_sql("lineitem_spike", ["l_quantity", "l_extendedprice", "l_discount"]))(
    lambda spark, sf: _r(ou.outlier_summary(dv.lineitem_spike(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"]), OUTLIER_VALUES))
register("outlier_summary_events_missing",
         with_views("events_missing") + "\n" + outlier_sql("events_missing", ["value", "user_id"]))(
    lambda spark, sf: _r(ou.outlier_summary(dv.events_missing(spark, sf), ["value", "user_id"]), OUTLIER_VALUES))
register("iqr_outliers_customer",
         "SELECT \"column\", total_values, iqr_outliers, iqr_percent, lower_bound, upper_bound FROM ("
         + outlier_sql("customer", ["c_acctbal"], 1) + ")")(
    lambda spark, sf: _r(ou.iqr_outliers(table(spark, sf, "customer"), ["c_acctbal"]), ["lower_bound", "upper_bound"]))
register("zscore_outliers_lineitem_spike",
         with_views("lineitem_spike") + "\nSELECT \"column\", total_values, zscore_outliers, zscore_percent, mean, std FROM ("
         + outlier_sql("lineitem_spike", ["l_quantity"], 1) + ")")(
    lambda spark, sf: _r(ou.zscore_outliers(dv.lineitem_spike(spark, sf), ["l_quantity"]), ["mean", "std"]))

register("outlier_rows_lineitem_spike", with_views("lineitem_spike") + """,
s AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem_spike)
SELECT CAST(l_quantity AS DOUBLE) AS value, greatest(q1 - 1.5 * (q3 - q1) - l_quantity, l_quantity - (q3 + 1.5 * (q3 - q1))) AS distance
FROM lineitem_spike, s WHERE l_quantity < q1 - 1.5 * (q3 - q1) OR l_quantity > q3 + 1.5 * (q3 - q1)
ORDER BY distance DESC, value DESC LIMIT 20""")(
    lambda spark, sf: ou.outlier_rows(dv.lineitem_spike(spark, sf), "l_quantity"))


def box_sql(source, cols):
    parts = []
    for c in cols:
        v = f"CAST({qi(c)} AS DOUBLE)"
        parts.append(f"""SELECT * FROM (
WITH s AS (SELECT min({v}) AS a, max({v}) AS z, avg({v}) AS m, stddev_samp({v}) AS sd, quantile_cont({v}, 0.25) AS q1,
                  quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3 FROM {source})
SELECT '{c}' AS "column", {srnd('a')} AS min, {srnd('q1')} AS q1, {srnd('q2')} AS median, {srnd('q3')} AS q3,
  {srnd('z')} AS max, {srnd('m')} AS mean, {srnd('sd')} AS std, {srnd('q1 - 1.5 * (q3 - q1)')} AS lower_fence,
  {srnd('q3 + 1.5 * (q3 - q1)')} AS upper_fence,
  {srnd(f'(SELECT min({v}) FROM {source} WHERE {v} >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
  {srnd(f'(SELECT max({v}) FROM {source} WHERE {v} <= q3 + 1.5 * (q3 - q1))')} AS whisker_high FROM s)""")
    return "\nUNION ALL\n".join(parts)


BOX_VALUES = ["min", "q1", "median", "q3", "max", "mean", "std", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]
register("box_summary_lineitem_spike", with_views("lineitem_spike") + "\n" + box_sql("lineitem_spike", ["l_quantity", "l_tax"]))(
    lambda spark, sf: _r(ou.box_summary(dv.lineitem_spike(spark, sf), ["l_quantity", "l_tax"]), BOX_VALUES))
