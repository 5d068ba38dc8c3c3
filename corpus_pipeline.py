"""Training-data pipeline over ``documents``: each stage works on all that its predecessor
kept, written as Parquet and read again.

language_id    documents without a learned language go (no letters, or rejected)
near_dedup     one document of every group of near copies stays, that with the smallest id
personal_data  personal data and terms that disclose it are replaced in the texts
packing        the remaining texts become packed training sequences (the last stage)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkeda.llm import langid, packing, pii, simhash
from sparkeda.llm.queries import table, tokenizer_path
from sparkeda.session import checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; models come from the labelled rows."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    return langid.keep_identified(docs, langid.train_models(rows.filter(~langid.held_out("id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document per SimHash component, that with the smallest id. Documents with
    the same id or none are told apart by their text; those without yield to those with one."""
    own = docs.columns
    keyed = docs.withColumn("__k", F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"),
                                            F.md5("text").alias("digest")))
    found = simhash.simhash_components(keyed, id_col="__k")
    first = found.filter(F.col("__k") == F.col("component_id")).select("__k").distinct()
    one = Window.partitionBy("__k").orderBy(F.xxhash64(*own))
    return keyed.join(first, "__k", "left_semi").withColumn("__row", F.row_number().over(one)) \
        .filter("__row = 1").select(*own)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; ``n_chars`` follows the text."""
    out = pii.sanitise(docs, whole_texts=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece of a document, with its place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]

#: Language models, fingerprints and packing cannot be written in SQL; tests/llm compares
#: the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared checkpoint folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
