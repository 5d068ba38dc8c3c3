"""Content-addressed WARC archive (operator 3).

An archive is two tables in one folder. ``payloads`` holds every distinct payload once,
gzip-compressed, under its SHA-256; ``records`` holds the exact header block of every
record and the digest of its payload. The original records (header, payload, two line
ends) come back by joining both; on the way out every payload's length and digest are
verified again. Payloads are compressed before they are shuffled, copies within a task
are dropped before, and only digests are grouped to find which record comes first.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .bpe import texts_in_slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SEEN = 1 << 20            # digests a task remembers; beyond that copies go on to the shuffle


def _payload(text: str | None) -> bytes:
    return (text or "").encode()


def _payload_rows(batches):
    """(digest, bytes, member) of the payloads a task holds, each once."""
    seen: set[bytes] = set()
    for batch in batches:
        for _, texts in texts_in_slices(batch.column(0)):
            digest, size, member = [], [], []
            for text in texts:
                raw = _payload(text)
                d = hashlib.sha256(raw)
                if d.digest() not in seen:
                    if len(seen) < _SEEN:
                        seen.add(d.digest())
                    digest.append(d.hexdigest())
                    size.append(len(raw))
                    member.append(gzip.compress(raw, compresslevel=6, mtime=0))
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.string()), pa.array(size, pa.int64()),
                                              pa.array(member, pa.binary())], ["digest", "size", "member"])


def _line(name: str, value) -> "F.Column":
    """A header line, none where the value is null; line ends inside values are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))).otherwise(F.lit(""))


def _urn(page) -> "F.Column":
    """Record id made from the page's id."""
    h = F.md5(F.concat(F.lit("page:"), page))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  smallest_revisit: int = 100, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write one record per row. Among records of equal payloads of at least
    ``smallest_revisit`` bytes the one with the smallest id is the response, the others are
    revisits that refer to it; smaller payloads are all responses. Null payloads are empty.
    Rows that repeat the smallest id are responses, as they are the same record; rows
    without an id revisit a record that has one."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    rows.select("html").mapInArrow(_payload_rows, "digest string, size long, member binary") \
        .dropDuplicates(["digest"]).write.option("compression", "none").parquet(f"{path}/payloads")
    raw = F.coalesce("html", F.lit("")).cast("binary")
    narrow = rows.select("page_id", "url", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("size"))
    first = narrow.filter(F.col("size") >= smallest_revisit).groupBy("digest").agg(F.min("page_id").alias("first"))
    # one digest may belong to a third of the pages: AQE splits that partition of the join
    typed = narrow.join(first, "digest", "left") \
        .withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    page = F.col("page_id").cast("string")
    refers = F.when(F.col("revisit"), F.col("first").cast("string"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\n"),
        _line("WARC-Record-ID", _urn(F.coalesce(page, F.concat(F.lit("none:"), F.coalesce("url", F.lit("")), "digest")))),
        F.lit(f"WARC-Date: {date}\r\n"), _line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        _line("X-Page-Id", page), _line("WARC-Refers-To", F.when(refers.isNotNull(), _urn(refers))),
        _line("X-Refers-To-Page", refers), _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("size").cast("string")), F.lit("\r\n\r\n"))
    typed.select("digest", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or lines[-2:] != ["", ""]:
        raise ValueError("not a WARC header block")
    return dict(line.split(": ", 1) for line in lines[1:-2])


def read_archive(spark: SparkSession, path: str, with_records: bool = False) -> DataFrame:
    """Records put together from an archive: (page_id, url, payload_bytes, payload_digest,
    record_type, refers_to) read from the headers and payloads, and ``with_records`` the
    payload and the record's bytes. A payload that is missing or does not match its digest
    or length fails the job."""
    records = spark.read.schema("digest string, header binary").parquet(f"{path}/records")
    payloads = spark.read.schema("digest string, size long, member binary").parquet(f"{path}/payloads")

    def rebuild(batches):
        for batch in batches:
            cols: dict[str, list] = {c: [] for c in ("page_id", "url", "payload_bytes", "payload_digest", "record_type",
                                                     "refers_to", "payload", "record")}
            checked: dict[str, bytes] = {}
            for digest, header, size, member in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if digest not in checked:
                    if member is None:
                        raise ValueError(f"payload {digest} is missing")
                    raw = gzip.decompress(member)
                    if len(raw) != size or hashlib.sha256(raw).hexdigest() != digest:
                        raise ValueError(f"payload {digest} is damaged")
                    checked = {digest: raw}                      # equal digests follow each other after the join
                raw, f = checked[digest], _fields(header)
                if f["WARC-Payload-Digest"] != f"sha256:{digest}":
                    raise ValueError(f"record of {digest} names another payload")
                body = b"" if f["WARC-Type"] == "revisit" else raw
                if int(f["Content-Length"]) != len(body):
                    raise ValueError(f"record of {digest} has another length")
                cols["page_id"].append(int(f["X-Page-Id"]) if "X-Page-Id" in f else None)
                cols["url"].append(f.get("WARC-Target-URI"))
                cols["payload_bytes"].append(len(raw))
                cols["payload_digest"].append(digest)
                cols["record_type"].append(f["WARC-Type"])
                cols["refers_to"].append(int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None)
                if with_records:
                    cols["payload"].append(raw)
                    cols["record"].append(header + body + b"\r\n\r\n")
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            kept = list(cols) if with_records else list(cols)[:6]
            yield pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in zip(kept, types)], kept)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    joined = records.join(payloads, "digest", "left").select("digest", "header", "size", "member")
    return joined.mapInArrow(rebuild, schema + (", payload binary, record binary" if with_records else ""))


def archive_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to a new archive below the shared folder and read it back."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **how)
    return read_archive(spark, path)
