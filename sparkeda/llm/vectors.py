"""What the vector searches share: usable vectors, and the best few per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): distinct rows with an id and a vector without null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")) \
        .filter("vec_id is not null and v is not null and size(v) > 0") \
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))) \
        .distinct()


def first_of_each(ids: np.ndarray) -> np.ndarray:
    """Places of the first of each id, in order."""
    return np.sort(np.unique(ids, return_index=True)[1])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def best(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query, ties to the
    smaller vec_id; a pair found more than once counts once."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", F.col("score").cast(score_type).alias("score"))


def cells_for(rows: int, per_cell: int, spark) -> int:
    """Number of work cells: about ``per_cell`` rows in each, and some for every core."""
    return max(-(-rows // per_cell), 8 * spark.sparkContext.defaultParallelism)
