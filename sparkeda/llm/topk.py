"""Exact top-k search by inner product (operator 6): multi-resolution segment statistics.

Vectors are cut into few, then more, segments; of each segment the mean and the deviation
are kept. Per segment of n components the squared distance of q and c is at least
n ((mean_q - mean_c)^2 + (dev_q - dev_c)^2), and with the lengths of q and c a lower
bound on the distance is an upper bound on the inner product. Candidates whose bound,
coarse to fine, is below the k-th best exact score known are out; exact integer inner products are
computed for the survivors only.

Queries and rows meet in blocks: a cell holds one block of rows and one block of queries
and gives out k rows per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best, cells_for, first_of_each, matrix, usable

QUERY_BLOCK = 1024
_EXACT = 2.0 ** 52


def _integers(m: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * m)


def _segments(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: about dim / 16 and dim / 4."""
    return sorted({max(1, dim // 16), max(1, dim // 4)})


def _statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, weighted so that the scalar product of two rows
    of statistics is the bound on the inner product."""
    out = []
    for part in np.array_split(np.arange(m.shape[1]), segments):
        x = m[:, part]
        mean = x.mean(axis=1)
        dev = np.sqrt(np.maximum((x * x).mean(axis=1) - mean * mean, 0.0))
        out += [mean * np.sqrt(len(part)), dev * np.sqrt(len(part))]
    return np.stack(out, axis=1)


def _exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; with numbers too large for doubles, in Python integers kept
    within a long."""
    if len(rows) == 0 or np.abs(rows).max() * np.abs(q).sum() < _EXACT:
        return (rows @ q).astype(np.int64)
    whole = [int(x) for x in q]
    sums = [sum(int(a) * b for a, b in zip(r, whole)) for r in rows]
    return np.array([max(-2 ** 63, min(2 ** 63 - 1, s)) for s in sums], dtype=np.int64)


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """For each query (index, ids, scores) of its best ``k`` ids: bounds first, then exact. An
    id with several rows counts once, by its best."""
    most = int(np.unique(ids, return_counts=True)[1].max(initial=1))
    wide = k * most                                           # rows that hold k ids at least
    levels = [(_statistics(rows, s), _statistics(queries, s)) for s in _segments(rows.shape[1])]
    row_len, query_len = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    slack = 1e-9 * (row_len.max(initial=0.0) + 1.0)           # for rounding in the bounds
    for i, q in enumerate(queries):
        here = np.flatnonzero(ids != query_ids[i])
        extra = slack * (query_len[i] + 1.0)
        floor = -np.inf
        for depth, (r, s) in enumerate(levels):
            bound = r[here] @ s[i] + extra
            if depth == 0 and len(here) > 4 * wide:           # a first k-th best from the best bounds
                first = here[np.argpartition(-bound, 4 * wide)[:4 * wide]]
                floor = float(np.partition(_exact(rows[first], q), -wide)[-wide])
            here = here[bound >= floor]
        score = _exact(rows[here], q)
        top = np.lexsort((ids[here], -score.astype(object) if score.min(initial=0) == -2 ** 63 else -score))
        top = top[first_of_each(ids[here][top])[:k]]
        yield i, ids[here][top], score[top]


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest inner product of
    floor(scale * component) per query row, exact, ties to the smaller vec_id.

    Rows without an id, and vectors that are null, empty or hold null or non-finite
    components, take no part; vectors of other lengths are not compared; rows with the
    query's own id are no candidates. Sums beyond a long are kept at its limits. A
    repeated query id is one query. Empty tables give an empty result."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    n, nq = rows.count(), asked.count()
    row_blocks = cells_for(n, 8192, spark) // 4 or 1
    query_blocks = -(-nq // QUERY_BLOCK) or 1
    # every row meets every query block; blocks are even whatever the vectors are
    left = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(row_blocks))) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"),
                         F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb")) \
        .withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.combine_chunks()
            ids, query_ids = np.asarray(a["vec_id"]), np.asarray(b["query_id"])
            va, vb = a["v"].combine_chunks(), b["qv"].combine_chunks()
            la, lb = np.asarray(va.value_lengths()), np.asarray(vb.value_lengths())
            for d in np.intersect1d(la, lb):
                ia, ib = np.flatnonzero(la == d), np.flatnonzero(lb == d)
                m, q = (_integers(matrix(v.take(pa.array(i))), scale) for v, i in ((va, ia), (vb, ib)))
                for i, best_ids, score in search_block(m, ids[ia], q, query_ids[ib], k):
                    found["query_id"].append(np.full(len(score), query_ids[ib][i]))
                    found["vec_id"].append(best_ids)
                    found["score"].append(score)
        return pa.table({c: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64))
                         for c, v in found.items()})

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(
        lambda a, b: cell(a, b), "query_id long, vec_id long, score long")
    return best(found, k, "long")
