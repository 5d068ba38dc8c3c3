"""Language-model scoring against a plain Python model."""

import math
import zlib
from collections import Counter

import pytest

from sparkeda.llm import lm, queries

from .helpers import clashing, edge_documents, words


def brute(rows, share, min_pair=2, d=0.75):
    """{row: (held_out, n_tokens, n_known, N, base, score)} from the definitions."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    seqs = [(i, [w.encode() for w in words(t)] + [b""]) for i, t in rows]
    c, pair = Counter(), Counter()
    for i, s in seqs:
        if not held(i):
            c.update(s)
    n, v = sum(c.values()), len(c)
    state = {w for w, k in c.items() if k >= max(1, share * n)} | {b""}
    for i, s in seqs:
        if not held(i):
            pair.update((a, b) for a, b in zip([b"", *s], s) if a in state and b in state)
    arcs = {p: k for p, k in pair.items() if k >= min_pair}
    left = {s: 1.0 for s in state}
    for (a, _), k in arcs.items():
        left[a] -= (k - d) / c[a]
    out = []
    for i, s in seqs:
        base = score = 0.0
        for a, b in zip([b"", *s], s):
            p1 = (c[b] + 1) / (n + v + 1)
            base += math.log10(p1)
            p = p1 if a not in state else left[a] * p1 + ((arcs[a, b] - d) / c[a] if (a, b) in arcs else 0)
            score += math.log10(p)
        out.append((i, held(i), len(s), sum(c[w] > 0 for w in s), n, base, score))
    return out


def _same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_equal_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op5_lm_scoring"](spark, sf).collect()
    _same([tuple(r) for r in got], brute([(r["doc_id"], r["text"]) for r in docs.collect()], 0))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    df = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = lm.score_texts(clashing(df), state_share=0.01)
    _same([tuple(r) for r in got.collect()], brute(rows, 0.01))
    assert lm.score_texts(df.limit(0)).count() == 0
    only = lm.score_texts(df.filter("doc_id in (0, 1)"))
    assert all(r["n_tokens"] == 1 for r in only.collect())


def test_small_memory_gives_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fresh = spark.createDataFrame(rows, "doc_id long, text string")
    _same([tuple(r) for r in lm.score_texts(fresh, state_share=0.001).collect()], brute(rows, 0.001))


def test_rare_words_have_arcs_in_a_large_corpus(spark):
    """No share of the tokens is asked of a word: a pair seen twice counts in any corpus."""
    rows = [(i, "often read " * 60_000) for i in range(4)]
    rows += [(10 + i, f"often meets seldom words here {i}") for i in range(30)] + [(50 + i, "quite seldom seen") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _same([tuple(r) for r in lm.score_texts(df).collect()], brute(rows, 0))
