"""Splits, folds, preprocessing and the neighbour candidate of the model comparison."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkeda.operators import ml


@pytest.fixture(scope="module")
def classes(spark):
    # a class with most rows, a small one, one of two rows, and rows without a class
    return spark.range(1000).withColumn("y", F.expr(
        "case when id < 700 then 'a' when id < 988 then 'b' when id < 990 then 'c' when id < 995 then null else 'd' end"))


def test_split_is_exact_per_class(classes):
    rows = ml.stratified_split(classes, "y", ["id"]).collect()
    assert len(rows) == len({r["id"] for r in rows}) == 1000
    tests = {}
    for r in rows:
        tests[r["y"]] = tests.get(r["y"], 0) + r["is_test"]
    assert tests == {"a": 140, "b": 58, "c": 0, None: 1, "d": 1}


def test_folds_hold_every_class_evenly(classes):
    rows = ml.split_and_folds(classes, "y", ["id"], 5, row="n").collect()
    assert sorted(r["n"] for r in rows) == list(range(1000))
    assert all((r["fold"] is None) == r["is_test"] for r in rows)
    for y, n in (("a", 560), ("b", 230)):
        per = [sum(r["y"] == y and r["fold"] == f for r in rows) for f in range(5)]
        assert per == [n // 5] * 5


def test_split_without_classes_cuts_all_rows(classes):
    rows = ml.split_and_folds(classes, None, ["id"], 3).collect()
    assert sum(r["is_test"] for r in rows) == 200
    assert sorted(sum(r["fold"] == f for r in rows) for f in range(3)) == [266, 267, 267]


def test_fill_values_come_from_the_learning_rows(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 3.0, "x"), (3, None, None), (4, 900.0, "z"), (5, 900.0, "z"),
                                (6, 900.0, "z")], "id int, v double, c string")
    filled, _ = ml.impute_scale_encode(df, ["v"], ["c"], fit_on=df.filter("id <= 2"))
    assert tuple(filled.filter("id = 3").first())[1:] == (2.0, "x")
    with pytest.raises(ValueError):
        ml.impute_scale_encode(df, [], [])


def test_neighbour_candidate_follows_the_vote(spark):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(60).selectExpr("id as __row", "cast(id % 3 as double) as label",
                                    "cast(id % 3 as double) * 10 + id / 100.0 as x")
    enc = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = ml.Neighbours(3).fit(enc.filter("__row < 45"))
    got = model.transform(enc.filter("__row >= 45")).collect()
    assert len(got) == 15 and all(r["prediction"] == r["label"] for r in got)


def test_many_equal_distances_keep_the_smallest_keys(spark):
    import pandas as pd
    train = pd.DataFrame({"tk": np.arange(5000)[::-1], "y": np.arange(5000)[::-1] % 7, "v": [np.ones(2000)] * 5000})
    query = pd.DataFrame({"qk": np.arange(7), "v": [np.zeros(2000)] * 7})
    out = ml._block_top_k(4)(train, query)
    assert len(out) == 28
    assert all(sorted(out[out.qk == k].tk) == [0, 1, 2, 3] for k in range(7))


def test_regression_needs_twenty_numeric_targets(spark):
    df = spark.range(40).selectExpr("id", "case when id < 15 then cast(id as string) else 'none' end as t", "id % 5 as f")
    with pytest.raises(ValueError, match="Not enough rows"):
        ml.tournament(df, "t", ["id"], task="regression")


def test_tournament_ranks_every_candidate(spark):
    df = spark.range(120).selectExpr("id as row_key", "case when id % 3 = 0 then 'yes' else 'no' end as outcome",
                                     "cast(id % 3 as double) + (id % 7) / 50.0 as amount", "concat('g', id % 4) as area")
    out = ml.tournament(df, "outcome", ["row_key"], task="classification")
    rows = out["models"].collect()
    assert [r["error"] for r in rows] == [None] * 5
    assert {r["model"] for r in rows} == {"Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting",
                                          "K-Nearest Neighbors"}
    assert sum(r["is_best"] for r in rows) == 1 and rows[0]["rank"] == 1
    assert max(r["cv_mean"] for r in rows) == [r["cv_mean"] for r in rows if r["is_best"]][0] >= 0.95
    assert [r["warning"] for r in out["warnings"].collect()] == ["Small training sample — metrics may be unstable."]


def test_the_models_that_take_longest_are_fitted_first(spark, monkeypatch):
    fitted = []

    class Seen:
        def __init__(self, depth):
            self.depth = depth

        def fit(self, train):
            fitted.append(self.depth)
            return ml.DecisionTreeRegressor(maxDepth=self.depth, seed=42).fit(train)

    monkeypatch.setattr(ml, "regressors", lambda n: [("Short", Seen(1)), ("Long", Seen(2))])
    df = spark.range(200).selectExpr("id as row_key", "concat('k', id % 3) as kind", "id % 3 * 2.5 + id % 5 as y")
    out = ml.tournament(df, "y", ["row_key"], task="regression", parallelism=1)["models"].collect()
    assert fitted == [2] * 6 + [1] * 6
    assert {r["model"]: r["position"] for r in out} == {"Short": 0, "Long": 1} and [r["error"] for r in out] == [None] * 2


def test_the_neighbour_vote_learns_from_every_training_row(spark, monkeypatch):
    learned = []

    class Seen(ml.Neighbours):
        def fit(self, train):
            learned.append(train.count())
            return self

        def transform(self, rows):
            return rows.withColumn("prediction", F.col("label"))

    monkeypatch.setattr(ml, "classifiers", lambda n, c: [("Seen", Seen(1))])
    df = spark.range(130_000).selectExpr("id as row_key", "case when id < 2 then 'rare' else 'most' end as outcome",
                                         "concat('k', id % 3) as kind")
    out = ml.tournament(df, "outcome", ["row_key"], task="classification")
    assert out["folds"] == 2 and [r["error"] for r in out["models"].collect()] == [None]
    assert max(learned) == 104_000 and sum(sorted(learned)[:2]) == 104_000
