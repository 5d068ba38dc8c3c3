"""The pipeline's stages: each takes effect, keeps what it should, and survives odd rows."""

import re

import corpus_pipeline as cp
from sparkeda.llm import langid

from .helpers import (brute_base, brute_components, brute_fingerprint, clashing, edge_documents)


def test_pipeline_stages_on_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for name, stage in cp.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r for r in docs.collect()})
    lang, dedup, clean, packed = kept
    assert docs.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert len(lang) >= 0.97 * len(before) and all(lang[i] == before[i] for i in lang)
    root = brute_components(brute_fingerprint(r["text"]) for r in lang.values())
    first = {}
    for i, r in lang.items():
        k = root[brute_fingerprint(r["text"])]
        first[k] = min(i, first.get(k, i))
    assert set(dedup) == set(first.values())
    assert set(clean) == set(dedup) == set(packed)
    for i, r in clean.items():
        old = dedup[i]["text"]
        assert not brute_base(re.sub(r"\[[A-Z]+\]", " ", r["text"]))
        assert r["text"] == old or brute_base(old) or "[TERM]" in r["text"]
        assert r["n_chars"] == len(r["text"])


def test_run_equals_its_stages(spark, sf):
    rows = cp.run(spark, sf)
    assert rows.count() > 0 and cp.ORACLE_SQL is None
    assert rows.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).collect()[0][0] <= 2048


def test_stages_on_odd_rows(spark, sf):
    df = clashing(edge_documents(spark))
    for name, stage in cp.STAGES[:3]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        assert stage(spark, df.limit(0), sf).count() == 0
    assert cp.pack(spark, df, sf).count() >= df.count()
    assert cp.pack(spark, df.limit(0), sf).count() == 0
    dedup = cp.near_dedup(spark, df, sf).collect()
    fps = brute_components(brute_fingerprint(r["text"]) for r in df.collect())
    assert len(dedup) == len(set(fps.values()))
    assert {r["doc_id"] for r in dedup if r["text"] == "no id here"} == {None}


def test_rejection_drops_unknown_scripts_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train_models(docs.select(docs.doc_id.alias("id"), "text", "lang"))
    df = spark.createDataFrame([(1, "это совсем другой язык и другие буквы " * 5), (2, "12 34"), (3, None),
                                (4, docs.filter("lang = 'de' and n_chars > 500").first()["text"])], "doc_id long, text string")
    assert [r["doc_id"] for r in langid.keep_identified(df, model).collect()] == [4]


def test_near_dedup_keeps_other_texts_of_a_repeated_id(spark, sf):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    df = spark.createDataFrame([(5, a), (5, b), (5, b), (3, b), (7, c), (9, c), (None, c)], "doc_id long, text string")
    got = cp.near_dedup(spark, df, sf).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, b), (5, a), (7, c)]
