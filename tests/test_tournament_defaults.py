"""The tournament's own choice of a target, and failures that are the cluster's."""

import pytest

from sparkeda.operators import ml


def test_no_target_qualifies(spark):
    df = spark.range(50).selectExpr("id", "cast(id as string) as s")
    with pytest.raises(ValueError, match="target"):
        ml.tournament(df, None, ["id"])


def test_target_is_the_best_candidate(spark, monkeypatch):
    df = spark.range(60).selectExpr("id", "id * 1.5 as x", "concat('c', id % 2) as flag", "concat('k', id % 7) as kind")
    seen = []
    monkeypatch.setattr(ml, "prepare_features", lambda d, target, keys: seen.append(target) or (_ for _ in ()).throw(KeyError(target)))
    with pytest.raises(KeyError):
        ml.tournament(df, None, ["id"])
    assert seen == ["kind"]


def test_faults_of_the_cluster_are_told_apart():
    for text in ("Job aborted: ExecutorLostFailure (executor 3 exited)", "java.io.IOException: No space left on device", "FetchFailed(BlockManagerId"):
        assert ml._CLUSTER_FAULT.search(text)
    for text in ("requirement failed: Nothing has been added to this summarizer.", "label column has too many classes"):
        assert not ml._CLUSTER_FAULT.search(text)
