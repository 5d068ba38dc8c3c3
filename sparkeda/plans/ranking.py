"""Ranking inside groups without sending a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import q
from ..sources.io import with_global_index


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                    salt_buckets: int = 64, salt_on: list[str] | None = None,
                    rank: str | None = None) -> DataFrame:
    """Top ``n`` rows per group (all rows when ``group`` is empty): first the top n
    inside each (group, salt) slice, then the top n of at most n x salt_buckets
    survivors per group, so a hot group never lands in one task. ``rank`` names
    an output column with the 1-based position."""
    salt = F.pmod(F.xxhash64(*[q(c) for c in (salt_on or df.columns)]), F.lit(salt_buckets))
    if not group:
        first = df.orderBy(*order).limit(n)  # a top-n plan: n rows per task, then n rows
        return first.withColumn(rank, F.row_number().over(Window.orderBy(*order))) if rank else first
    keys = [q(g) for g in group]
    w1 = Window.partitionBy(*keys, F.col("__salt")).orderBy(*order)
    pre = (df.withColumn("__salt", salt).withColumn("__r", F.row_number().over(w1))
           .filter(F.col("__r") <= n).drop("__r", "__salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)  # <= n x salt_buckets rows per group
    out = pre.withColumn("__r", F.row_number().over(w2)).filter(F.col("__r") <= n)
    return out.withColumnRenamed("__r", rank) if rank else out.drop("__r")


def rank_in_groups(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank",
                   top: int | None = None) -> DataFrame:
    """1-based ``rank`` within each group in ``order`` (which must be total).
    With ``top``: the salted top-n. Without: a range-partitioned global numbering;
    each group's first number (one row per group) is subtracted back."""
    if top:
        return top_n_per_group(df, group, order, top, rank=rank)
    keys = [q(g) for g in group]
    idx = with_global_index(df, keys + order, "__gi")
    if not group:
        return idx.withColumn(rank, (F.col("__gi") + 1).cast("long")).drop("__gi")
    first = idx.groupBy(*[q(g).alias(g) for g in group]).agg(F.min("__gi").alias("__g0"))
    joined = idx.join(first, group)  # one row per group; AQE splits a hot one
    return joined.withColumn(rank, (F.col("__gi") - F.col("__g0") + 1).cast("long")).drop("__gi", "__g0")
