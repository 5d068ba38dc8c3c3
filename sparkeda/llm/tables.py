"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint_dir


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read back: cuts the
    lineage like a checkpoint, but columnar and compressed."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
