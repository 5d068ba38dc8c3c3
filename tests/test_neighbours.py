"""Exact neighbour vote and fuzzy vocabulary match against brute force on small fixtures."""

import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparkeda.operators import adhoc as ad
from sparkeda.operators import ml


def _brute_knn(train, test, k):
    tv = np.array([r[1] for r in train], dtype=np.float64)
    out = {}
    for qk, qv in test:
        d = ((tv - np.array(qv, dtype=np.float64)) ** 2).sum(axis=1)
        order = sorted(range(len(train)), key=lambda i: (d[i], train[i][0]))[:k]
        votes = Counter(train[i][2] for i in order)
        best = max(votes.values())
        out[qk] = min(y for y, n in votes.items() if n == best)
    return out


def test_knn_vote_equals_brute_force(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    s = ml.stratified_split(e, "label", ["vec_id"])
    train, test = s.filter(~F.col("is_test")), s.filter(F.col("is_test"))
    # small blocks so that several (query block, train block) cells meet
    got = {r["vec_id"]: r["prediction"] for r in
           ml.knn_vote(train, test, "embedding", "label", "vec_id", block_rows=37).collect()}
    tr = [(r["vec_id"], r["embedding"], r["label"]) for r in train.collect()]
    te = [(r["vec_id"], r["embedding"]) for r in test.collect()]
    k = min(5, len(tr) // 10 or 1)
    assert got == _brute_knn(tr, te, k)


def test_a_block_needs_little_beside_its_rows():
    """A whole block of rows against many queries, apart and without the row itself."""
    r = np.random.default_rng(2)
    v = r.integers(0, 50, (16384, 8)).astype(np.float64)
    tr = pd.DataFrame({"tk": np.arange(16384), "y": np.arange(16384) % 3, "v": list(v)})
    for without in (False, True):
        te = pd.DataFrame({"qk": np.arange(600), "v": list(v[:600])})
        tracemalloc.start()
        got = ml._block_top_k(5, without)(tr.copy(), te)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60_000_000
        for qk in (0, 17, 599):
            d = ((v - v[qk]) ** 2).sum(axis=1)
            if without:
                d[qk] = np.inf
            assert list(got["tk"][got["qk"] == qk]) == sorted(range(16384), key=lambda i: (d[i], i))[:5]


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _brute_match(values, vocab, cutoff):
    out = {}
    for v in values:
        best = None
        for e in vocab:
            m = max(len(v), len(e))
            score = 1.0 if m == 0 else 1.0 - _lev(v, e) / m
            exact = v.lower() == e.lower()
            if exact or score >= cutoff:
                cand = (not exact, -score, e)
                best = cand if best is None or cand < best else best
        out[v] = (v, None) if best is None else (best[2], 1.0 if not best[0] else round(-best[1], 6))
    return out


def test_vocabulary_match_equals_brute_force(spark):
    vocab = ["GERMANY", "FRANCE", "UNITED STATES", "UNITED KINGDOM", "PERU", "IRAN", "IRAQ",
             "CHINA", "INDIA", "ab", "a", "", "USA", "usa", "Usa "]
    values = ["germany", "FRANXE", "UNITED STATEZ", "UNITED KINGDON", "PERX", "IRAK", "IRAN",
              "CHIAN", "INDAI", "xyz", "b", "ab", "", "A", "UNITED", "KINGDOM UNITED", "Usa", "uSA", "usa "]
    for cutoff in (0.5, 0.7, 0.9):
        m = ad.match_to_vocabulary(spark.createDataFrame([(v,) for v in values], "name string"), "name",
                                   spark.createDataFrame([(e,) for e in vocab], "entry string"), "entry",
                                   cutoff=cutoff)
        got = {r["value"]: (r["match"], None if r["score"] is None else round(r["score"], 6))
               for r in m.collect()}
        assert got == _brute_match(values, vocab, cutoff), cutoff


def test_vocabulary_match_random_strings(spark):
    import random
    rnd = random.Random(7)
    def word():
        return "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
    vocab = sorted({word() for _ in range(60)})
    values = sorted({word() for _ in range(120)})
    for cutoff in (0.4, 0.6, 0.8):
        m = ad.match_to_vocabulary(spark.createDataFrame([(v,) for v in values], "name string"), "name",
                                   spark.createDataFrame([(e,) for e in vocab], "entry string"), "entry",
                                   cutoff=cutoff)
        got = {r["value"]: (r["match"], None if r["score"] is None else round(r["score"], 6))
               for r in m.collect()}
        assert got == _brute_match(values, vocab, cutoff), cutoff


def test_vocabulary_match_rejects_cutoff_outside_unit_interval(spark):
    import pytest
    df = spark.createDataFrame([("a",)], "name string")
    for bad in (0.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            ad.match_to_vocabulary(df, "name", df, "name", cutoff=bad)


def _clusters(n=600, dims=6, centres=12, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dims)) * 40
    which = r.integers(0, centres, n)
    return [(i, [float(x) for x in c[w] + r.normal(size=dims)], int(w)) for i, w in enumerate(which)]


def test_clustered_rows_visit_few_blocks(spark):
    rows = _clusters()
    df = spark.createDataFrame(rows, "id long, v array<double>, y long")
    near, how = ml.nearest_neighbours(df, df, "v", "y", "id", 4, block_rows=60, exclude_self=True)
    got = {}
    for r in near.orderBy("qk", "d", "tk").collect():
        got.setdefault(r["qk"], []).append(r["tk"])
    x = np.array([r[1] for r in rows])
    for i in range(len(rows)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert got[i] == sorted(range(len(rows)), key=lambda j: (d[j], j))[:4]
    assert how["visits"] < 0.5 * how["of"], how


def test_equal_vectors_and_large_cells(spark):
    rows = [(i, [1.0, 2.0], i % 3) for i in range(150)] + [(200 + i, [5.0 + i, 2.0], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y long")
    near, _ = ml.nearest_neighbours(df, df, "v", "y", "id", 3, block_rows=20, exclude_self=True)
    got = {}
    for r in near.orderBy("qk", "d", "tk").collect():
        got.setdefault(r["qk"], []).append(r["tk"])
    assert got[10] == [0, 1, 2] and got[0] == [1, 2, 3] and got[200] == [201, 202, 203]
    few, how = ml.nearest_neighbours(df.limit(2), df, "v", "y", "id", 5)
    assert few.groupBy("qk").count().agg({"count": "max"}).collect()[0][0] == 2 and how["visits"] == 155
    assert ml.nearest_neighbours(df.limit(0), df, "v", "y", "id", 5)[0].count() == 0
