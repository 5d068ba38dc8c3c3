"""Dirty views derived from the driver tables (the tables hold no nulls).

Each view is built from a whole table with column expressions only, so its
size grows with the table; the SQL twins are in ``queries/_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_missing(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id",
                    F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
                    F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "props")


def events_mostly_null(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), "props")


def events_blank(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    i = F.col("event_id")
    blank_all, null_all, mixed = i % 13 == 0, i % 17 == 0, i % 19 == 0

    def first_half(v):  # null in the mixed rows
        return F.when(blank_all, F.lit("")).when(null_all | mixed, F.lit(None)).otherwise(v)

    def second_half(v):  # blank in the mixed rows
        return F.when(blank_all | mixed, F.lit("")).when(null_all, F.lit(None)).otherwise(v)

    return e.select(first_half(i.cast("string")).alias("event_id"),
                    first_half(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
                    second_half(F.col("user_id").cast("string")).alias("user_id"),
                    second_half(F.col("event_type")).alias("event_type"),
                    second_half(F.col("props")).alias("props"))


def events_words(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select("event_id",
                    F.when(F.col("event_id") % 2 == 0, " Yes").otherwise("no ").alias("yn"),
                    F.when(F.col("event_id") % 3 == 0, "TRUE").otherwise("false").alias("tf"),
                    F.lit("yes").alias("all_yes"), "event_type")


def events_dates(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd")
    return e.select("event_id", iso.alias("d_iso"), F.date_format("ts", "MM/dd/yyyy").alias("d_us"),
                    F.when(F.col("event_id") % 10 < 3, F.lit("not a date")).otherwise(iso).alias("d_garbage"),
                    "event_type")


def events_spellings(spark, sf_dir) -> DataFrame:
    """Date spellings with one-digit parts, month names, offsets and without seconds."""
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "M/d/yyyy").alias("d_short"),
                    F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("d_zulu"),
                    F.date_format("ts", "MMM d, yyyy").alias("d_month"),
                    F.date_format("ts", "yyyy-MM-dd HH:mm").alias("d_minutes"))


def events_numtext(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select("event_id",
                    F.when(F.col("event_id") % 101 == 0, F.lit("1d"))
                    .when(F.col("event_id") % 4 == 0, F.lit("n/a"))
                    .otherwise(F.col("value").cast("string")).alias("value_text"))


def events_headers(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias(" Event ID"), F.col("user_id").alias("user-id"),
                    F.col("value").alias("Value "), F.col("event_type").alias("value"))


def orders_dup(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.unionByName(o.filter(F.col("o_orderkey") % 10 == 0))


def lineitem_const(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").withColumn("c_const", F.lit(5.0).cast("double"))


def lineitem_spike(spark, sf_dir) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 500 == 0, F.col("l_quantity") * 100)
                         .otherwise(F.col("l_quantity")))


def doc_paths(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))
    return d.select("doc_id", F.when(F.col("doc_id") % 50 == 0, name)
                    .otherwise(F.concat_ws("/", "source", "lang", name)).alias("path"))


def doc_quality(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = _t(spark, sf_dir, "labels")
    return d.join(lab, "doc_id")


def events_empty_cols(spark, sf_dir) -> DataFrame:
    """events with an all-null, an all-blank and a whitespace-only column."""
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", "event_type", F.lit(None).cast("string").alias("nothing"),
                    F.lit("").alias("blank"), F.lit("   ").alias("spaces"), "value")


def events_headers_sql_names() -> list[str]:
    return [" Event ID", "user-id", "Value ", "value"]


def typos(spark, sf_dir) -> DataFrame:
    """One name per customer: its nation's name with the character at position
    (custkey mod length) + 1 replaced by 'x' for even custkeys, the name in lower
    case (an exact case-insensitive match) for odd ones. Grows with ``customer``."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cn = c.join(n, c["c_nationkey"] == n["n_nationkey"])  # nation: 25 rows, broadcast by the planner
    typo = F.concat(F.expr("substring(n_name, 1, (c_custkey % length(n_name)))"), F.lit("x"),
                    F.expr("substring(n_name, (c_custkey % length(n_name)) + 2)"))
    return cn.select(F.when(F.col("c_custkey") % 2 == 0, typo).otherwise(F.lower("n_name")).alias("name"))


def doc_sections(spark, sf_dir) -> DataFrame:
    """documents.text re-laid as sections: line i (0-based) becomes a
    'SECTION: <lang>' header when i % 5 = 2, else a '- ' item (lines 0 and 1
    come before any header)."""
    d = _t(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    laid = F.transform(lines, lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("SECTION: "), F.col("lang")))
                       .otherwise(F.concat(F.lit("- "), x)))
    return d.select("doc_id", F.array_join(laid, "\n").alias("text"))


def image_bytes(spark, sf_dir) -> DataFrame:
    """The first bytes of a PNG, GIF, BMP or JPEG file for each vector, of sizes that follow from its number."""
    e = _t(spark, sf_dir, "embeddings")
    w, h, kind = (F.col("vec_id") % 700 + 16), (F.col("vec_id") % 500 + 9), F.col("vec_id") % 4

    def number(v, n, little=False):
        big = F.lpad(F.hex(v), 2 * n, "0")
        return F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(n))]) if little else big

    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 4), number(h, 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), number(w, 2, True), number(h, 2, True), F.lit("F70000"))
    bmp = F.concat(F.lit("424D" + "00" * 16), number(w, 4, True), number(h, 4, True), F.lit("0100180000000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), number(h, 2), number(w, 2), F.lit("03012200021101031101"))
    text = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, bmp).otherwise(jpeg)
    return e.select("vec_id", F.col("label").cast("string").alias("label"), F.unhex(text).alias("content"))
