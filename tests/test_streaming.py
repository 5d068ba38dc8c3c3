import os
import tempfile

from sparkeda.operators import stats as st
from sparkeda.operators import text as tx
from sparkeda.streaming import profile_each_batch, row_local


def test_row_local_text_on_stream(spark, sf):
    src = tempfile.mkdtemp(prefix="sparkeda-stream-src-")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.write.mode("overwrite").parquet(os.path.join(src, "part"))
    stream = spark.readStream.schema(docs.schema).parquet(os.path.join(src, "part"))
    out = row_local(stream, lambda d: tx.strip_markdown(d, "text"))
    q = out.writeStream.format("memory").queryName("md_stream").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["doc_id"]: r["text"] for r in spark.table("md_stream").collect()}
    exp = {r["doc_id"]: r["text"] for r in tx.strip_markdown(docs, "text").collect()}
    assert got == exp


def test_profile_each_batch(spark, sf):
    src = tempfile.mkdtemp(prefix="sparkeda-stream-ev-")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.write.mode("overwrite").parquet(os.path.join(src, "ev"))
    sink = tempfile.mkdtemp(prefix="sparkeda-stream-sink-")
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(src, "ev"))
    q = profile_each_batch(stream, st.missing_profile, os.path.join(sink, "out"), "mp_stream")
    q.awaitTermination(120)
    res = spark.read.parquet(os.path.join(sink, "out"))
    assert res.select("column").distinct().count() == len(ev.columns)
