"""Ranked lexical search (operator 13) with per-term geometric blocking.

Scores add up integer term impacts (see ``ranked_search``). Documents are indexed in shards
of a few thousand rows, in the tasks that hold them. In a shard every posting list is
clustered by document similarity: documents are projected to a few dimensions, put to the
nearest of some pivot documents, and a list is cut into blocks of neighbours in that order.
A block keeps the coordinatewise maximum of its documents' impacts as its summary. For an
item, weights times summary bound every score in the block from above, exactly, as impacts
are never negative; a block is left out only when that bound is below the item's tenth best
score so far. Only lists of essential terms are walked: an item's terms of least possible
gain, which together cannot reach its floor, cannot bring in a document on their own.

Spark gathers the statistics (document count, length, document frequencies), spreads the
shards and merges the best of each. Items come in blocks of bounded text, so that what is
broadcast (terms, weights, floors) is bounded whatever the number of items.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import texts_in_slices
from .tables import written

_BLOCK = 32                # postings of a block
_PIVOTS = 32
_CELLS = 1 << 24           # documents x terms of a shard's dense part
_TOGETHER = 256            # items whose bounds are found in one matrix product
_ITEM_CHARS = 4_000_000    # text of an item block
#: every byte that is no letter, digit or part of a non-ASCII character parts terms; A-Z in lower case
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def _forward(vocabulary):
    """(id, n, terms, counts) of documents with terms: numbers and occurrences of those the items ask for."""
    def run(batches):
        number = vocabulary.value
        for batch in batches:
            for at, texts in texts_in_slices(batch.column(1)):
                keep, size, which, how_often = [], [], [], []
                for i, text in enumerate(texts):
                    found = terms(text)
                    if found:
                        asked = [(number[t], c) for t, c in Counter(found).items() if t in number]
                        keep.append(i)
                        size.append(len(found))
                        which.append(np.array([t for t, _ in asked], "<i4").tobytes())
                        how_often.append(np.array([c for _, c in asked], "<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)).take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()),
                     pa.array(which, pa.binary()), pa.array(how_often, pa.binary())], ["id", "n", "terms", "counts"])
    return run


def _flat(batch: pa.RecordBatch, n_docs: int, n_all: int):
    """Rows, term numbers and impacts of the postings of a batch of _forward."""
    raw = batch.column(2).to_pylist()
    size = np.array([len(x) // 4 for x in raw], dtype=np.int64)
    term = np.frombuffer(b"".join(raw), "<i4")
    tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i8")
    m = 100 - 90 + (90 * np.asarray(batch.column(1)).astype(np.int64) * n_docs) // n_all
    row = np.repeat(np.arange(len(size)), size)
    return row, term, (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])


def _term_facts(n_terms: int, n_docs: int, n_all: int):
    """(term, df, most): documents that hold a term and its greatest impact."""
    def run(batches):
        df, most = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            _, term, gain = _flat(batch, n_docs, n_all)
            df += np.bincount(term, minlength=n_terms)
            np.maximum.at(most, term, gain)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held]), pa.array(most[held])], ["term", "df", "most"])
    return run


class _Best:
    """The k best (score, id) of every item met so far, and its floor."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.astype(np.float64).copy()
        self.rows: list[list] = [[] for _ in floors]

    def offer(self, item: int, scores: np.ndarray, ids: list):
        rows = self.rows[item]
        rows += [(-int(s), i is None, i) for s, i in zip(scores, ids)]
        rows.sort()
        del rows[self.k:]
        if len(rows) == self.k:
            self.floor[item] = max(self.floor[item], -rows[-1][0])


def _search_shard(row, term, gain, ids: list, items: list[np.ndarray], first: int, weight, most, best: _Best):
    """Offer every document of a shard that may be among the best of ``items`` (numbered from ``first``)."""
    cols = np.unique(np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64))
    place = np.full(len(weight), -1)
    place[cols] = np.arange(len(cols))
    ours = place[term] >= 0
    x = np.zeros((len(ids), len(cols)), np.float32)               # impacts are below 2 ** 24, so exact
    x[row[ours], place[term[ours]]] = gain[ours]
    # similar documents next to each other: nearest pivot, then place along one direction
    flat = x @ np.random.default_rng(7).standard_normal((len(cols), 16)).astype(np.float32)
    flat /= np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
    pivots = flat[np.linspace(0, len(ids) - 1, min(_PIVOTS, len(ids))).astype(int)]
    order = np.lexsort((flat[:, 0], (flat @ pivots.T).argmax(axis=1)))
    x = x[order]
    w = weight[cols].astype(np.float64)
    mine = [place[t] for t in items]
    lists: dict[int, list[int]] = {}
    for j, cs in enumerate(mine):
        gains = w[cs] * most[cols[cs]]
        by_gain = np.argsort(gains, kind="stable")
        idle = np.cumsum(gains[by_gain]) < best.floor[first + j]   # cannot reach the floor even together
        for c in cs[by_gain[~idle]]:
            lists.setdefault(int(c), []).append(j)
    seen = np.zeros((len(items), len(ids)), bool)
    # rare terms first: their documents raise the floors
    for c in sorted(lists, key=lambda c: -w[c]):
        members = np.flatnonzero(x[:, c])
        if not len(members):
            continue
        asked = np.array(lists[c])
        near = np.unique(np.concatenate([mine[j] for j in asked]))
        at = np.searchsorted(near, np.arange(len(cols)))
        rows = x[members] if 2 * len(near) > len(cols) else x[np.ix_(members, near)]
        if 2 * len(near) > len(cols):
            rows = rows[:, near]
        starts = np.arange(0, len(members), _BLOCK)
        summary = np.maximum.reduceat(rows, starts, axis=0).astype(np.float64)
        weights = np.zeros((len(near), len(asked)))
        for a, j in enumerate(asked):
            weights[at[mine[j]], a] = w[mine[j]]
        bound = summary @ weights
        for a, j in enumerate(asked):
            open_blocks = bound[:, a] >= max(1.0, best.floor[first + j])
            if not open_blocks.any():
                continue
            take = np.repeat(open_blocks, _BLOCK)[:len(members)] & ~seen[j, members]
            take = np.flatnonzero(take)
            if not len(take):
                continue
            seen[j, members[take]] = True
            scores = rows[np.ix_(take, at[mine[j]])].astype(np.float64) @ w[mine[j]]
            good = scores >= max(1.0, best.floor[first + j])
            if np.count_nonzero(good) > best.k:                    # ties of the k-th stay
                good &= scores >= np.partition(scores[good], -best.k)[-best.k]
            if good.any():
                best.offer(first + j, scores[good], [ids[order[members[i]]] for i in take[good]])


def _search(model, id_type: pa.DataType):
    """(item, id, score): a task's best documents of every item."""
    def run(batches):
        items, weight, most, floors, k, n_docs, n_all = model.value
        best = _Best(floors, k)
        most_rows = max(256, _CELLS // max(1, min(len(weight), 64 * _TOGETHER)))

        def search(parts):
            flat, ids, base = [], [], 0
            for p in parts:
                r, t, g = _flat(p, n_docs, n_all)
                flat.append((r + base, t, g))
                ids += p.column(0).to_pylist()
                base += p.num_rows
            row, term, gain = (np.concatenate(c) for c in zip(*flat))
            for at in range(0, len(items), _TOGETHER):
                _search_shard(row, term, gain, ids, items[at:at + _TOGETHER], at, weight, most, best)

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, most_rows - n), batch.slice(most_rows - n)
                held.append(part)
                n += part.num_rows
                if n == most_rows:
                    search(held)
                    held, n = [], 0
        if n:
            search(held)
        found = [(j, i, -s) for j, rows in enumerate(best.rows) for s, _, i in rows]
        for at in range(0, len(found), 100_000):
            part = found[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in part], pa.int32()), pa.array([f[1] for f in part], id_type),
                 pa.array([f[2] for f in part], pa.int64())], ["item", "id", "score"])
    return run


def _item_blocks(items: DataFrame, item_col: str, text_col: str):
    """Lists of (item, its distinct terms), each of bounded text."""
    asked = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    size = asked.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = 1 + size // _ITEM_CHARS
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else asked
        yield [(r["item"], sorted(set(terms(r["text"])))) for r in part.collect()]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): the k best documents of every item, score above 0.

    A document with tf occurrences of a term and n terms in all adds, for each distinct term
    of the item, w * ((10^9 tf) div (1000 tf + 8 m)), where m = 10 + (90 n N) div L,
    w = floor(1000 ln((2N + 2) / (2 df + 1))), N counts the documents with a term and L their
    terms. Whole texts of any length count. Null or empty texts and texts without terms are
    never found and count in no statistic; items without terms give no rows. Every row is a
    document of its own: equal rows take a rank each. Equal scores go by ascending id, null
    ids last. Items of the same id and text count once; one id with several texts is ranked
    for each text. Empty tables give an empty result."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    arrow_id = to_arrow_type(kind)
    item_type = items.schema[item_col].dataType
    results = []
    for block in _item_blocks(items, item_col, item_text_col):
        number: dict[bytes, int] = {}
        asked = [np.array([number.setdefault(t, len(number)) for t in ts], dtype=np.int64) for _, ts in block]
        if not number:
            continue
        vocabulary = spark.sparkContext.broadcast(number)
        forward = written(narrow.mapInArrow(_forward(vocabulary), f"id {kind.simpleString()}, n long, terms binary, counts binary"),
                          "search-forward")
        total = forward.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("all")).collect()[0]
        n_docs, n_all = total["n"], total["all"]
        if not n_docs:
            continue
        facts = forward.mapInArrow(_term_facts(len(number), n_docs, n_all), "term long, df long, most long") \
            .groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect()
        weight, most = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        for r in facts:                                            # at most the terms of an item block
            weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
            most[r["term"]] = r["most"]

        def best(rows, floors):
            model = spark.sparkContext.broadcast((asked, weight, most, floors, k, n_docs, n_all))
            found = rows.mapInArrow(_search(model, arrow_id), f"item int, id {kind.simpleString()}, score long")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
            return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        # any documents give a floor: their k-th best score is reached by k documents
        floors = np.zeros(len(asked), np.int64)
        for r in best(forward.filter(F.pmod(F.xxhash64("id", "n", "terms"), F.lit(64)) == 0), floors) \
                .filter(F.col("rank") == k).select("item", "score").collect():
            floors[r["item"]] = r["score"]
        names = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(block)], f"item int, name {item_type.simpleString()}")
        results.append(best(forward, floors).join(F.broadcast(names), "item")
                       .select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
    if not results:
        return spark.createDataFrame([], f"`{item_col}` {item_type.simpleString()}, rank int, `{id_col}` {kind.simpleString()}, score long")
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out
