"""Vector searches against brute force."""

import numpy as np
import pytest

from sparkeda.llm import ann, queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, v string"


def odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)], 1, 0.0, 0, "x") for i in range(150)]
    rows += [(200 + i, rows[0][1], 1, 0.0, 0, "x") for i in range(40)]          # ties: copies of one vector
    rows += [(300, None, 1, 0.0, 0, "x"), (350, [], 1, 0.0, 0, "x"), (400, [0.0] * 8, 1, 0.0, 0, "x"),
             (401, [None] + [1.0] * 7, 1, 0.0, 0, "x"), (402, [float("nan")] * 8, 1, 0.0, 0, "x"),
             (403, [float("inf")] * 8, 1, 0.0, 0, "x"), (None, [1.0] * 8, None, None, None, None),
             (404, [1.0, 2.0], 1, 0.0, 0, "x"), rows[3], (500, [1e30] * 8, 1, 0.0, 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def ok(rows, zero):
    out = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[r["vec_id"]] = np.array(v, dtype=np.float32).astype(float)
    return out


def brute_inner(vs, every, k):
    out = []
    ints = {i: [int(x) for x in np.floor(1024 * v)] for i, v in vs.items()}
    for q in (i for i in vs if i % every == 0):
        s = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(ints[q], ints[c])))), c)
             for c in vs if c != q and len(ints[c]) == len(ints[q])]
        out += [(q, n + 1, c, -x) for n, (x, c) in enumerate(sorted(s)[:k])]
    return sorted(out)


def test_top_k_is_exact(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = queries.QUERIES["op6_top_k"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == brute_inner(ok(rows, True), 100, 10)


def test_top_k_edges(spark):
    df = odd_rows(spark)
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), k=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_inner(ok(df.collect(), True), 50, 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_segment_bounds_never_undercut():
    r = np.random.default_rng(2)
    m, q = np.floor(1024 * r.normal(size=(300, 64))), np.floor(1024 * r.normal(size=(20, 64)))
    for s in topk._segments(64):
        assert (topk._statistics(m, s) @ topk._statistics(q, s).T >= m @ q.T - 1e-3).all()


def brute_cosine(vs, every, k):
    out = {}
    for q in (i for i in vs if i % every == 0):
        a = vs[q]
        s = [(-(a * vs[c]).sum() / np.sqrt((a * a).sum()) / np.sqrt((vs[c] ** 2).sum()), c)
             for c in vs if c != q and len(vs[c]) == len(a)]
        out[q] = [(c, -x) for x, c in sorted(s)[:k]]
    return out


def check(got, want, recall):
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q, pairs in want.items():
        mine = sorted(by.get(q, []), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        true = dict(pairs)
        hits += sum(r["vec_id"] in true for r in mine)
        for r in mine:
            if r["vec_id"] in true:
                assert r["score"] == pytest.approx(true[r["vec_id"]], abs=1e-12)
        total += len(pairs)
    assert set(by) <= set(want) and hits >= recall * total


def test_nearest_reaches_its_recall(spark, sf):
    small = sf.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    got = queries.QUERIES["op2_nearest_neighbours"](spark, small).collect()
    check(got, brute_cosine(ok(rows, False), 50, 5), 0.9)


def test_nearest_edges(spark):
    df = odd_rows(spark)
    want = brute_cosine(ok(df.collect(), False), 50, 5)
    for part_rows in (1024, 4):                                   # whole and split buckets
        got = ann.nearest(df, df.filter("vec_id % 50 = 0"), success=0.9999, near=0.2, width=4.0, hashes=2,
                          part_rows=part_rows).collect()
        check(got, want, 0.999)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_probes_come_in_the_order_of_success():
    h = ann.Hasher(16, 1, 3, 1.0, 1)
    r = np.random.default_rng(3)
    q = r.normal(size=16)
    q /= np.linalg.norm(q)
    visited = h.probes(0, q, 0.6, 0.9)
    assert len(set(visited.tolist())) == len(visited)
    noise = r.normal(size=(20000, 16))
    noise -= (noise @ q)[:, None] * q
    near = 0.6 * q + 0.8 * noise / np.linalg.norm(noise, axis=1)[:, None]
    share = np.isin(h.buckets(0, near), visited).mean()
    assert share > 0.85


@pytest.mark.parametrize("copies", [1, 30])
def test_repeated_rows_push_nobody_out(spark, copies):
    """The nearest row many times over, and one id with many vectors, count once."""
    r = np.random.default_rng(9)
    near = r.normal(size=8)
    rows = [(0, near)] + [(i, near + 0.05 * i * r.normal(size=8)) for i in range(1, 60)]
    rows += [(1, rows[1][1])] * copies + [(2, rows[2][1] * (1 + j / 100)) for j in range(copies)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").coalesce(1)
    asked = df.filter("vec_id = 0")
    best_of = lambda f: sorted(((-max(f(v) for j, v in rows if j == i), i) for i in range(1, 60)))[:5]
    cos = best_of(lambda v: v @ near / np.sqrt(v @ v) / np.sqrt(near @ near))
    got = sorted(ann.nearest(df, asked, success=1 - 1e-9, width=8.0, hashes=2).collect(), key=lambda x: x["rank"])
    assert [x["vec_id"] for x in got] == [i for _, i in cos]
    assert [x["score"] for x in got] == pytest.approx([-x for x, _ in cos])
    q = np.floor(1024 * near)
    inner = best_of(lambda v: int(np.floor(1024 * v) @ q))
    got = sorted(topk.top_k(df, asked, k=5).collect(), key=lambda x: x["rank"])
    assert [(-x["score"], x["vec_id"]) for x in got] == inner
    m = np.array([v for _, v in rows])
    ((_, ids, score),) = topk.search_block(np.floor(1024 * m), np.array([i for i, _ in rows]), q[None], np.array([0]), 5)
    assert list(zip(-score, ids)) == inner


def test_small_tables_give_all_rows(spark):
    """With the default parameters a query gets every other row of a table of four or six."""
    r = np.random.default_rng(11)
    schema = "vec_id long, embedding array<double>"
    for n in (4, 6):
        df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=64)]) for i in range(n)], schema)
        vs = {x["vec_id"]: np.array(x["embedding"]) for x in df.collect()}
        got = sorted((x["query_id"], x["rank"], x["vec_id"]) for x in ann.nearest(df, df).collect())
        assert got == [(q, i + 1, c) for q, best in sorted(brute_cosine(vs, 1, 5).items()) for i, (c, _) in enumerate(best)]
