"""Ratio matching equals difflib over all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from sparkeda.operators import adhoc as ad


def _brute(values, vocabulary, cutoff):
    out = set()
    for v in values:
        same = sorted(e for e in vocabulary if e.lower() == v.lower())
        if same:
            out.add((v, same[0], 1.0))
            continue
        scored = [(SequenceMatcher(None, e, v).ratio(), e) for e in vocabulary]
        score, e = max(((s, e) for s, e in scored if s >= cutoff), default=(None, v))
        out.add((v, e, score))
    return out


@pytest.mark.parametrize("cutoff", [0.5, 0.7, 0.9, 1.0])
def test_ratio_equals_difflib(spark, cutoff):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aabbcde_é") for _ in range(r.randint(1, 12)))
    vocabulary = sorted({word() for _ in range(80)} | {"", "customer_id", "Order_Date", "order_date", "😀x"})
    values = {word() for _ in range(150)} | {"", "custmer_id", "ORDER_DATE", "order-dates", "😀xy", "zzz", "date_order", "a" * 30}
    values |= {v[::-1] for v in list(values)[:20]}
    df = spark.createDataFrame([(v,) for v in values] + [(None,), ("zzz",)], "v string")
    voc = spark.createDataFrame([(e,) for e in vocabulary] + [(None,)], "e string")
    got = {(x["value"], x["match"], x["score"]) for x in ad.match_by_ratio(df, "v", voc, "e", cutoff).collect()}
    assert got == _brute(values, vocabulary, cutoff)
    assert ad.match_by_ratio(df, "v", voc.limit(0), "e").filter("score is not null").count() == 0
