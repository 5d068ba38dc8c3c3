"""WARC archive and URL filters."""

import gzip
import hashlib
import re

import pytest

from sparkeda.llm import queries, urls, warc

PAGES = "page_id long, url string, html string, digest string, host string, path string, rule string, size long"


def odd_pages(spark):
    big = "<p>é</p>" * 40
    rows = [(3, "http://a.net/x", big), (1, "HTTP://B.Example.COM/de/x?y#z", big), (2, None, big), (None, "x", big),
            (4, "https://example.org/fr/", None), (5, "no scheme", ""), (6, "http://h\r\n/p", "short"), (7, "u", "short"),
            (8, "http://example.net/en/a", "z" * 99), (9, "http://x.example.net/de/", "z" * 99), (10, "http://net", "z" * 100),
            (11, "http://org/fr/", "z" * 100), (12, "http://badnet/", "y" * 300_000), (3, "http://a.net/x", big),
            (13, "a://b://c/d", "w"), (14, "http://example.com/de", "w"), (15, "://", "w"), (16, "http://m.org/fr/?/x", "w")]
    return spark.createDataFrame([(*r, "d", "h", "p", "r", 1) for r in rows], PAGES)


def brute_records(rows):
    first, out = {}, []
    raw = [(r["page_id"], (r["html"] or "").encode()) for r in rows]
    for i, p in raw:
        if i is not None and len(p) >= 100:
            first[p] = min(i, first.get(p, i))
    for i, p in raw:
        revisit = p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=repr)


def test_archive_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert sorted((tuple(r) for r in queries.QUERIES["op3_warc"](spark, sf).collect()), key=repr) == brute_records(rows)


def test_archive_round_trip_of_odd_pages(spark, tmp_path):
    df, path = odd_pages(spark), str(tmp_path / "a")
    warc.write_archive(df, path)
    got = warc.read_archive(spark, path, with_records=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got),
                  key=repr) == brute_records(df.collect())
    assert sorted(r["payload"] for r in got) == sorted((r["html"] or "").encode() for r in df.collect())
    for r in got:
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and body.endswith(b"\r\n\r\n")
        assert body[:-4] == (b"" if r["record_type"] == "revisit" else r["payload"])
    stored = spark.read.parquet(f"{path}/payloads").collect()
    assert len(stored) == len({r["html"] or "" for r in df.collect()})
    assert all(hashlib.sha256(gzip.decompress(s["member"])).hexdigest() == s["digest"] for s in stored)


def test_damaged_payload_is_noticed(spark, tmp_path):
    df, path = odd_pages(spark), str(tmp_path / "a")
    warc.write_archive(df, path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "size + 1 as size", "member")
    bad.write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, f"{path}-bad").collect()
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def brute_url(u):
    if not u or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p) for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[1] if fit else None


def check_urls(got, rows):
    want = {(r["page_id"], *brute_url(r["url"])) for r in rows}
    assert {(r["page_id"], r["host"], r["path"], r["rule"]) for r in got} == want and len(got) == len(rows)
    action = {h + p: a for a, h, p in urls.RULES}
    for r in got:
        assert r["verdict"] == action.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")


def test_url_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    check_urls(queries.QUERIES["op9_url_filters"](spark, sf).collect(), rows)


def test_urls_edges_and_labels(spark):
    df = odd_pages(spark)
    check_urls(urls.filter_urls(df).collect(), df.collect())
    assert urls.filter_urls(df.limit(0)).count() == 0
    none = urls.filter_urls(df, labelled=spark.createDataFrame([], "url string, label int"))
    assert {r["verdict"] for r in none.collect() if r["rule"] is None} == {"allow"}


def test_regression_learns_held_out_urls(spark):
    mk = lambda i: (f"http://{'spam' if i % 2 else 'news'}{i}.biz/{'casino' if i % 2 else 'world'}/{i}", i % 2)
    labelled = spark.createDataFrame([mk(i) for i in range(200)] + [(None, 1), ("http://x", None)], "url string, label int")
    df = spark.createDataFrame([(i, mk(i)[0]) for i in range(200, 300)], "page_id long, url string")
    got = urls.filter_urls(df, labelled).collect()
    assert all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got)
