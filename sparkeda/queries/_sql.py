"""DuckDB spellings used by the oracle statements (independent of the Spark code)."""

from __future__ import annotations

from ..functions.values import (EMAIL_KEYWORDS, IDENTIFIER_KEYWORDS, KEY_NAME_PATTERNS,
                                NUMBER_RE, PHONE_PATTERNS, SENSIBLE_ID_PATTERNS)

# Driver table columns and their coarse kinds (as read from the parquet files).
TABLES = {
    "events": [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
               ("event_type", "string"), ("value", "numeric"), ("props", "string")],
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"),
                 ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "datetime")],
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "numeric"), ("s_name", "string"), ("s_nationkey", "numeric"),
                 ("s_acctbal", "numeric")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "nation": [("n_nationkey", "numeric"), ("n_name", "string"), ("n_regionkey", "numeric")],
    "region": [("r_regionkey", "numeric"), ("r_name", "string")],
    "labels": [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")],
}

NUM_RE_SQL = NUMBER_RE.replace("'", "''")


def rnd(e: str, digits: int = 4) -> str:
    """Same IEEE steps as ``functions.exprs.rnd``."""
    scale = float(10 ** digits)
    t = f"(abs({e}) * {scale} + 0.5)"
    return f"(CAST(sign({e}) AS DOUBLE) * (({t} - {t} % 1.0) / {scale}))"


def qi(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def num_value(c: str, kind: str) -> str:
    if kind == "numeric":
        return f"CAST({qi(c)} AS DOUBLE)"
    if kind == "string":
        return (f"CASE WHEN regexp_full_match({qi(c)}, '{NUM_RE_SQL}') "
                f"THEN TRY_CAST(trim({qi(c)}) AS DOUBLE) END")
    return "CAST(NULL AS DOUBLE)"


def name_test(c: str, patterns) -> str:
    low = lit(c) + ""
    return "(" + " OR ".join(f"contains(lower({low}), {lit(p)})" for p in patterns) + ")"


def facts_sql(source: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        nv = num_value(c, kind)
        if kind == "string":
            castable, castable_d = f"count({nv})", f"count(DISTINCT {nv})"
            avg_len = f"avg(length({qi(c)}))"
        elif kind == "numeric":
            castable, castable_d, avg_len = f"count({qi(c)})", f"count(DISTINCT {qi(c)})", "CAST(NULL AS DOUBLE)"
        else:
            castable, castable_d, avg_len = "0", "0", "CAST(NULL AS DOUBLE)"
        if kind in ("string", "numeric"):
            mn, mx = f"min({nv})", f"max({nv})"
            integral = f"(count({nv}) > 0 AND count(CASE WHEN {nv} % 1 <> 0 THEN 1 END) = 0)"
        else:
            mn = mx = "CAST(NULL AS DOUBLE)"
            integral = "false"
        parts.append(
            f"SELECT {i} AS position, {lit(c)} AS \"column\", {lit(kind)} AS kind, "
            f"CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count({qi(c)}) AS BIGINT) AS nulls, "
            f"CAST(count(DISTINCT {qi(c)}) AS BIGINT) AS distinct_count, "
            f"CAST({castable} AS BIGINT) AS castable, CAST({castable_d} AS BIGINT) AS castable_distinct, "
            f"CAST({avg_len} AS DOUBLE) AS avg_len, CAST({mn} AS DOUBLE) AS num_min, "
            f"CAST({mx} AS DOUBLE) AS num_max, {integral} AS integral, "
            f"{name_test(c, KEY_NAME_PATTERNS)} AS key_name, "
            f"{name_test(c, SENSIBLE_ID_PATTERNS)} AS sensible_id_name, "
            f"{name_test(c, PHONE_PATTERNS)} AS phone_name, "
            f"{name_test(c, IDENTIFIER_KEYWORDS)} AS ident_name, "
            f"{name_test(c, EMAIL_KEYWORDS)} AS email_name FROM {source}")
    return "\nUNION ALL\n".join(parts)


def roles_ctes(source: str, cols: list[tuple[str, str]]) -> str:
    """CTEs f (facts) and r (facts + role flags) for a table or CTE name."""
    return f"""f AS ({facts_sql(source, cols)}),
r0 AS (SELECT *, CASE WHEN rows > 0 THEN distinct_count / rows ELSE 0 END AS unique_ratio,
              CASE WHEN rows > 0 THEN nulls / rows ELSE 0 END AS null_ratio FROM f),
r1 AS (SELECT *, ((unique_ratio > 0.95 AND null_ratio < 0.05)
                  OR (unique_ratio > 0.90 AND key_name AND null_ratio < 0.05)) AS is_key FROM r0),
r2 AS (SELECT *, CASE WHEN kind = 'numeric' THEN (distinct_count > 10 OR unique_ratio > 0.1)
                      WHEN kind = 'string' THEN (castable > rows * 0.5 AND (castable_distinct > 10
                           OR (CASE WHEN castable > 0 THEN castable_distinct / castable ELSE 0 END) > 0.1))
                      ELSE false END AS is_numeric FROM r1),
r3 AS (SELECT *, (NOT is_key AND NOT (sensible_id_name AND unique_ratio > 0.95)
                  AND NOT coalesce(phone_name AND num_min >= 1e9 AND num_max < 1e15 AND unique_ratio > 0.8, false))
                 AS is_sensible,
                 CASE WHEN is_key OR unique_ratio > 0.95 THEN false
                      WHEN kind = 'string' THEN NOT (email_name AND unique_ratio > 0.8)
                                            AND NOT (ident_name AND unique_ratio > 0.9)
                      WHEN kind = 'numeric' THEN distinct_count <= 20 AND unique_ratio < 0.1
                      WHEN kind = 'boolean' THEN true
                      ELSE false END AS is_categorical FROM r2),
r AS (SELECT *, CASE WHEN is_key THEN 'identifiers' WHEN kind = 'datetime' THEN 'datetime'
                     WHEN is_numeric THEN 'numeric' WHEN is_categorical THEN 'categorical'
                     WHEN coalesce(avg_len, 0) >= 20 THEN 'text' ELSE 'categorical' END AS group_name,
                (is_key OR unique_ratio > 0.95) AS is_unique FROM r3)"""


# ---- derived (dirty) views, DuckDB spelling; Spark twins live in sources/derived.py ----

DERIVED = {
    "events_missing": """SELECT event_id, ts, user_id,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
        CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events""",
    "events_mostly_null": """SELECT event_id, ts, user_id, event_type,
        CASE WHEN event_id % 3 = 0 THEN value END AS value, props FROM events""",
    "events_blank": """SELECT
        CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL
             ELSE CAST(event_id AS VARCHAR) END AS event_id,
        CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN NULL
             ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
        CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL
             ELSE CAST(user_id AS VARCHAR) END AS user_id,
        CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL
             ELSE event_type END AS event_type,
        CASE WHEN event_id % 13 = 0 OR event_id % 19 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL
             ELSE props END AS props
        FROM events""",
    "events_words": """SELECT event_id,
        CASE WHEN event_id % 2 = 0 THEN ' Yes' ELSE 'no ' END AS yn,
        CASE WHEN event_id % 3 = 0 THEN 'TRUE' ELSE 'false' END AS tf,
        'yes' AS all_yes, event_type FROM events""",
    "events_dates": """SELECT event_id, strftime(ts, '%Y-%m-%d') AS d_iso,
        strftime(ts, '%m/%d/%Y') AS d_us,
        CASE WHEN event_id % 10 < 3 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d') END AS d_garbage,
        event_type FROM events""",
    "events_numtext": """SELECT event_id,
        CASE WHEN event_id % 101 = 0 THEN '1d' WHEN event_id % 4 = 0 THEN 'n/a'
             ELSE CAST(value AS VARCHAR) END AS value_text FROM events""",
    "events_empty_cols": """SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS nothing, '' AS blank,
        '   ' AS spaces, value FROM events""",
    "typos": """SELECT CASE WHEN c_custkey % 2 = 0 THEN substr(n_name, 1, c_custkey % length(n_name)) || 'x'
        || substr(n_name, (c_custkey % length(n_name)) + 2) ELSE lower(n_name) END AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "doc_sections": """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
        lambda x, i: CASE WHEN (i - 1) % 5 = 2 THEN 'SECTION: ' || lang ELSE '- ' || x END), chr(10)) AS text
        FROM documents""",
    "orders_dup": """SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0""",
    "lineitem_const": """SELECT *, 5.0::DOUBLE AS c_const FROM lineitem""",
    "lineitem_spike": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
        CASE WHEN l_orderkey % 500 = 0 THEN l_quantity * 100 ELSE l_quantity END AS l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem""",
    "doc_paths": """SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN CAST(doc_id AS VARCHAR) || '.jpg'
        ELSE source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.jpg' END AS path FROM documents""",
    "doc_quality": """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n]})" for n in names)
