"""JSON form of a profile, seeded samples and the inventory of a folder."""

import json

from sparkeda.plans import analysis as an
from sparkeda.sources import io


def test_profile_json_is_valid_and_whole(spark):
    df = spark.createDataFrame([(1, float("inf"), 'a "quoted"\nname'), (2, float("nan"), "ü"), (3, 2.5, None)] * 4,
                               "id long, v double, s string")
    rows = an.profile_json(df).collect()
    frames = an.profile(df)
    assert {r["section"] for r in rows} == set(frames)
    for section, frame in frames.items():
        payloads = [json.loads(r["payload"], parse_constant=lambda c: 1 / 0) for r in rows if r["section"] == section]
        assert len(payloads) == frame.count()
        assert all(set(p) == set(frame.columns) for p in payloads)
    texts = {json.loads(r["payload"])["value"] for r in rows if r["section"] == "value_counts"}
    assert texts == {'a "quoted"\nname', "ü", "NoData"}


def test_profile_sections_can_be_picked(spark):
    df = spark.createDataFrame([(1, "x")], "id long, s string")
    assert set(an.profile(df, sections=["missing", "value_counts", "datetime"])) == {"missing", "value_counts"}


def test_profile_json_of_an_empty_table(spark):
    rows = an.profile_json(spark.createDataFrame([], "s string")).collect()
    assert {r["section"] for r in rows} == {"missing", "duplicates"}


def test_sample_has_exactly_n_rows_and_is_repeatable(spark):
    df = spark.range(20_000).selectExpr("id", "id % 3 as g")
    a = {r["id"] for r in io.sample_rows(df, 700, keys=["id"]).collect()}
    b = {r["id"] for r in io.sample_rows(df.repartition(7), 700, keys=["id"]).collect()}
    assert len(a) == 700 and a == b
    assert a != {r["id"] for r in io.sample_rows(df, 700, seed=1, keys=["id"]).collect()}
    assert io.sample_rows(df, 50_000).count() == 20_000


def test_inventory_lists_the_folder(spark, sf):
    got = {r["dataset"]: r["rows"] for r in io.dataset_inventory(spark, sf).collect()}
    assert len(got) == 14 and got["region"] == 5
