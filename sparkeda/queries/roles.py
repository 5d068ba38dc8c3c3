"""Role-inference queries (T1-T15) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import facts as fx
from ..plans import roles as ro
from ..registry import register, table
from ..sources import derived as dv
from ..functions.exprs import rnd
from ._sql import TABLES, rnd as srnd, roles_ctes, with_views

ROLE_OUT = ["position", "column", "kind", "rows", "nulls", "distinct_count", "unique_ratio",
            "null_ratio", "is_key", "is_numeric", "is_sensible", "is_categorical", "group_name",
            "is_unique"]

ROLE_SQL = ("SELECT position, \"column\", kind, rows, nulls, distinct_count, " + srnd("unique_ratio") + " AS unique_ratio, "
            + srnd("null_ratio") + " AS null_ratio, is_key, is_numeric, is_sensible, is_categorical, "
            "group_name, is_unique FROM r")


def _roles_out(df):
    r = ro.column_roles(df)
    return r.select(*[rnd(F.col(c)).alias(c) if c.endswith("ratio") else F.col(c) for c in ROLE_OUT])


def _reg_roles(tname: str):
    register(f"column_roles_{tname}",
             f"WITH {roles_ctes(tname, TABLES[tname])}\n{ROLE_SQL}")(
        lambda spark, sf, _t=tname: _roles_out(table(spark, sf, _t)))


for _t in ["events", "lineitem", "orders", "customer", "supplier", "part", "nation", "labels"]:
    _reg_roles(_t)

_FLAGS = ["position", "column", "kind", "is_key", "is_numeric", "is_sensible", "is_categorical", "group_name", "is_unique"]
for _t in ["events", "lineitem", "orders", "customer", "part"]:
    register(f"column_role_flags_{_t}",
             f"WITH {roles_ctes(_t, TABLES[_t])}\nSELECT " + ", ".join(f'"{c}"' for c in _FLAGS) + " FROM r")(
        lambda spark, sf, _t=_t: ro.column_role_flags(table(spark, sf, _t)))

_MISSING_COLS = TABLES["events"]
register("column_roles_events_missing",
         with_views("events_missing") + f",\n{roles_ctes('events_missing', _MISSING_COLS)}\n{ROLE_SQL}")(
    lambda spark, sf: _roles_out(dv.events_missing(spark, sf)))

_NUMTEXT = [("event_id", "numeric"), ("value_text", "string")]
register("column_roles_events_numtext",
         with_views("events_numtext") + f",\n{roles_ctes('events_numtext', _NUMTEXT)}\n{ROLE_SQL}")(
    lambda spark, sf: _roles_out(dv.events_numtext(spark, sf)))


@register("column_facts_lineitem",
          f"WITH {roles_ctes('lineitem', TABLES['lineitem'])}\n"
          "SELECT position, \"column\", kind, rows, nulls, distinct_count, castable, castable_distinct, "
          + srnd("avg_len") + " AS avg_len, num_min, num_max, integral FROM f")
def _facts_lineitem(spark, sf):
    f = fx.column_facts(table(spark, sf, "lineitem"))
    return f.select("position", "column", "kind", "rows", "nulls", "distinct_count", "castable",
                    "castable_distinct", rnd(F.col("avg_len")).alias("avg_len"), "num_min", "num_max",
                    "integral")


@register("column_facts_part",
          f"WITH {roles_ctes('part', TABLES['part'])}\n"
          "SELECT position, \"column\", kind, rows, nulls, distinct_count, castable, castable_distinct, "
          + srnd("avg_len") + " AS avg_len, num_min, num_max, integral FROM f")
def _facts_part(spark, sf):
    f = fx.column_facts(table(spark, sf, "part"))
    return f.select("position", "column", "kind", "rows", "nulls", "distinct_count", "castable",
                    "castable_distinct", rnd(F.col("avg_len")).alias("avg_len"), "num_min", "num_max",
                    "integral")


for _t in ["events", "lineitem", "orders", "customer"]:
    register(f"primary_keys_{_t}",
             f"WITH {roles_ctes(_t, TABLES[_t])}\nSELECT position, \"column\", " + srnd("unique_ratio") + " AS unique_ratio, "
             + srnd("null_ratio") + " AS null_ratio FROM r WHERE is_key")(
        lambda spark, sf, _t=_t: ro.detect_primary_keys(table(spark, sf, _t)).select(
            "position", "column", rnd(F.col("unique_ratio")).alias("unique_ratio"),
            rnd(F.col("null_ratio")).alias("null_ratio")))

register("entity_id_orders",
         f"WITH {roles_ctes('orders', TABLES['orders'])}\n"
         "SELECT \"column\" FROM r WHERE is_key ORDER BY position LIMIT 1")(
    lambda spark, sf: ro.detect_entity_id(table(spark, sf, "orders")))

for _t in ["events", "lineitem", "part"]:
    register(f"column_groups_{_t}",
             f"WITH {roles_ctes(_t, TABLES[_t])}\nSELECT group_name, position, \"column\" FROM r")(
        lambda spark, sf, _t=_t: ro.column_groups(table(spark, sf, _t)))

for _t in ["lineitem", "orders", "customer", "part"]:
    register(f"candidate_targets_{_t}",
             f"WITH {roles_ctes(_t, TABLES[_t])}\nSELECT position, \"column\", distinct_count FROM r "
             "WHERE NOT is_key AND is_categorical AND distinct_count BETWEEN 2 AND 20")(
        lambda spark, sf, _t=_t: ro.detect_candidate_targets(table(spark, sf, _t)))

for _t in ["lineitem", "orders", "customer", "part"]:
    _shares = " UNION ALL ".join(
        f"SELECT '{_c}' AS col, round(max(n) / sum(n), 3) AS maj, count(*) AS d FROM "
        f"(SELECT count(*) AS n FROM {_t} WHERE {_c} IS NOT NULL GROUP BY {_c})"
        for _c, _ in TABLES[_t])
    register(f"auto_select_target_{_t}",
             f"WITH {roles_ctes(_t, TABLES[_t])}, shares AS ({_shares})\n"
             "SELECT \"column\", round(1.0 - maj + d / 20.0, 6) AS score FROM r JOIN shares ON shares.col = r.\"column\" "
             "WHERE NOT is_key AND is_categorical AND distinct_count BETWEEN 2 AND 20 ORDER BY 1.0 - maj + d / 20.0 DESC, position LIMIT 1")(
        lambda spark, sf, _t=_t: ro.auto_select_target(table(spark, sf, _t)).withColumn("score", F.round("score", 6)))

for _t in ["events", "lineitem", "customer"]:
    register(f"skipped_columns_{_t}",
             f"WITH {roles_ctes(_t, TABLES[_t])}\nSELECT position, \"column\", " + srnd("unique_ratio * 100", 2) + " AS uniqueness, "
             "CASE WHEN is_key THEN 'Detected primary key' ELSE 'High uniqueness - likely identifier/primary key' END AS reason "
             "FROM r WHERE NOT is_categorical AND (is_key OR unique_ratio > 0.95)")(
        lambda spark, sf, _t=_t: ro.skipped_columns(table(spark, sf, _t)))


def _visual_sql(tname: str, min_n: int, hi: int, k: int, exclude: str | None = None) -> str:
    cols = TABLES[tname]
    var_parts = [f"SELECT {i} AS pos, var_samp(\"{c}\") AS variance, count(\"{c}\") AS n_values FROM {tname}"
                 for i, (c, kind) in enumerate(cols) if kind == "numeric"]
    excl = f" AND \"column\" <> '{exclude}'" if exclude else ""
    return f"""WITH {roles_ctes(tname, cols)},
v AS ({' UNION ALL '.join(var_parts)}),
s AS (
  SELECT 'numeric' AS role, position, "column", coalesce(v.variance, 0) * (1 - null_ratio) AS score
  FROM r JOIN v ON r.position = v.pos WHERE NOT is_key AND is_numeric AND v.n_values >= {min_n}{excl}
  UNION ALL
  SELECT 'categorical' AS role, position, "column", (1 - null_ratio) / greatest(1.0, ln(distinct_count + 1)) AS score
  FROM r WHERE NOT is_key AND NOT is_numeric AND is_categorical AND distinct_count BETWEEN 2 AND {hi}{excl})
SELECT role, position, "column", {srnd("score")} AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, position) AS rank FROM s) WHERE rank <= {k}"""


for _t in ["lineitem", "orders", "part"]:
    register(f"visual_columns_{_t}", _visual_sql(_t, 3, 4611686018427387904, 30))(
        lambda spark, sf, _t=_t: ro.select_visual_columns(table(spark, sf, _t)).withColumn(
            "score", rnd(F.col("score"))))

register("prediction_features_lineitem", _visual_sql("lineitem", 10, 200, 40, "l_returnflag"))(
    lambda spark, sf: ro.select_prediction_features(table(spark, sf, "lineitem"), "l_returnflag")
    .withColumn("score", rnd(F.col("score"))))


def _task_sql(tname, col, is_float):
    reg = f"(count(DISTINCT {col}) > 20)" if is_float else "false"
    return (f"SELECT '{col}' AS \"column\", CASE WHEN {reg} OR (count(DISTINCT {col}) > 30 AND "
            f"count(DISTINCT {col}) / count(*) > 0.1) THEN 'regression' ELSE 'classification' END AS task FROM {tname}")


register("task_type_l_quantity", _task_sql("lineitem", "l_quantity", True))(
    lambda spark, sf: ro.detect_task_type(table(spark, sf, "lineitem"), "l_quantity"))
register("task_type_l_extendedprice", _task_sql("lineitem", "l_extendedprice", True))(
    lambda spark, sf: ro.detect_task_type(table(spark, sf, "lineitem"), "l_extendedprice"))
register("task_type_quality", _task_sql("labels", "quality", False))(
    lambda spark, sf: ro.detect_task_type(table(spark, sf, "labels"), "quality"))

register("datetime_columns_events_dates",
         with_views("events_dates") + """, p AS (
  SELECT count(*) AS rows,
    count(d_iso) AS n1, count(try_strptime(d_iso, ['%Y-%m-%d', '%m/%d/%Y'])) AS p1,
    count(d_us) AS n2, count(try_strptime(d_us, ['%Y-%m-%d', '%m/%d/%Y'])) AS p2,
    count(d_garbage) AS n3, count(try_strptime(d_garbage, ['%Y-%m-%d', '%m/%d/%Y'])) AS p3,
    count(event_type) AS n4, count(try_strptime(event_type, ['%Y-%m-%d', '%m/%d/%Y'])) AS p4
  FROM events_dates)
SELECT position, "column" FROM (
  SELECT 1 AS position, 'd_iso' AS "column", n1 AS n, p1 AS p, rows FROM p UNION ALL
  SELECT 2, 'd_us', n2, p2, rows FROM p UNION ALL
  SELECT 3, 'd_garbage', n3, p3, rows FROM p UNION ALL
  SELECT 4, 'event_type', n4, p4, rows FROM p) WHERE p = n AND p > rows * 0.8""")(
    lambda spark, sf: ro.detect_datetime_columns(dv.events_dates(spark, sf)))

register("datetime_columns_orders",
         "SELECT 4 AS position, 'o_orderdate' AS \"column\" FROM orders "
         "HAVING count(o_orderdate) > count(*) * 0.8")(
    lambda spark, sf: ro.detect_datetime_columns(table(spark, sf, "orders")))
