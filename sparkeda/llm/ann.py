"""Approximate nearest neighbours by cosine (operator 2): multiprobe p-stable hashing.

Vectors are scaled to length one and hashed in every table by ``hashes`` Gaussian
projections cut into intervals of ``width``. A query estimates for each bucket the
probability that a neighbour of cosine ``near`` falls into it - its projection is normal
around ``near`` times the query's own - and visits buckets, its own and perturbed ones, from
the most to the least probable until they add up to ``success`` in each table. Queries that
have met fewer than ``k`` rows go on to less probable buckets, at last to all. Every row
is indexed. Candidates of all tables are measured exactly on the original vectors.

Buckets are work units keyed (table, bucket); those with more than ``part_rows`` rows are
split into parts by the row's hash and a query visits every part, so no bucket is capped
and a hot one is spread. A query's vector goes once to each work cell with the list of its
buckets there.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .vectors import best, cells_for, first_of_each, matrix, usable

_PHI = np.vectorize(lambda x: 0.5 * (1.0 + erf(x / sqrt(2.0))), otypes=[float])
_SPAN = 64                 # interval numbers are kept within +-_SPAN


class Hasher:
    """The projections of all tables for vectors of one length, from a seed."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.width, self.dim = width, dim
        self.a = rng.normal(size=(tables, dim, hashes))
        self.b = rng.uniform(0, width, size=(tables, hashes))

    def code(self, t: int, cells: np.ndarray) -> np.ndarray:
        """Bucket number of interval numbers (rows x hashes) in table ``t``."""
        out = np.full(len(cells), self.dim * 64 + t, dtype=np.int64)
        for j in range(cells.shape[1]):
            out = out * (2 * _SPAN + 1) + np.clip(cells[:, j], -_SPAN, _SPAN) + _SPAN
        return out

    def buckets(self, t: int, unit: np.ndarray) -> np.ndarray:
        return self.code(t, np.floor((unit @ self.a[t] + self.b[t]) / self.width).astype(np.int64))

    def probes(self, t: int, unit: np.ndarray, near: float, success: float, least: float = 1e-6) -> np.ndarray:
        """Buckets one query visits, in the order of estimated success."""
        y, sigma = unit @ self.a[t], sqrt(max(1e-9, 1.0 - near * near))
        prob, cells = np.ones(1), np.zeros((1, 0), dtype=np.int64)
        for j, (centre, b) in enumerate(zip(near * y, self.b[t])):
            lo, hi = (int(np.floor((centre + s * 4 * sigma + b) / self.width)) for s in (-1, 1))
            h = np.arange(lo, hi + 1)
            p = np.diff(_PHI((np.append(h, hi + 1) * self.width - b - centre) / sigma))
            prob = (prob[:, None] * p).ravel()
            cells = np.column_stack([np.repeat(cells, len(h), axis=0), np.tile(h, len(cells))])
            keep = prob > least
            prob, cells = prob[keep], cells[keep]
        order = np.argsort(-prob, kind="stable")
        n = int(np.searchsorted(np.cumsum(prob[order]), success)) + 1
        return self.code(t, cells[order[:n]])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _by_length(batch: pa.RecordBatch):
    """(ids, matrix, list column) of the rows of each vector length in a batch (vec_id, v)."""
    size = np.asarray(batch.column(1).value_lengths())
    for d in np.unique(size):
        part = batch.filter(pa.array(size == d))
        yield np.asarray(part.column(0)), matrix(part.column(1)), part.column(1)


def _measure(k: int):
    """Cogroup step of one work cell: exact cosines of the rows in the visited buckets."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        if rows.num_rows and asks.num_rows:
            rows, asks = rows.combine_chunks(), asks.combine_chunks()
            unit_key = np.asarray(rows["unit"])
            order = np.argsort(unit_key, kind="stable")
            unit_key = unit_key[order]
            ids, vectors = np.asarray(rows["vec_id"])[order], rows["v"].combine_chunks().take(pa.array(order))
            query_id, query_v = np.asarray(asks["query_id"]), asks["qv"].combine_chunks()
            units = asks["units"].combine_chunks()
            size = np.asarray(units.value_lengths())
            ask_unit, ask_row = np.asarray(units.flatten()), np.repeat(np.arange(len(size)), size)
            by = np.argsort(ask_unit, kind="stable")
            ask_unit, ask_row = ask_unit[by], ask_row[by]
            for u in np.intersect1d(unit_key, ask_unit):
                a, b = np.searchsorted(unit_key, [u, u + 1])
                c, d = np.searchsorted(ask_unit, [u, u + 1])
                x = matrix(vectors.slice(a, b - a))
                most = int(np.unique(ids[a:b], return_counts=True)[1].max())
                norm = np.sqrt((x * x).sum(axis=1))
                for i in ask_row[c:d]:
                    q = np.asarray(query_v[int(i)].values, dtype=np.float64)
                    if len(q) != x.shape[1]:
                        continue
                    # row by row, so equal vectors get equal scores wherever they lie
                    score = (x * q).sum(axis=1) / (norm * np.sqrt((q * q).sum()))
                    score[ids[a:b] == query_id[i]] = -np.inf
                    # an id with several vectors counts once, by its best
                    wide = k * most
                    if len(score) > wide:
                        cut = np.partition(score, len(score) - wide)[len(score) - wide]
                        near = np.flatnonzero(score >= cut)
                    else:
                        near = np.arange(len(score))
                    near = near[score[near] > -np.inf]
                    near = near[np.lexsort((ids[a:b][near], -score[near]))]
                    near = near[first_of_each(ids[a:b][near])[:k]]
                    found.setdefault(int(query_id[i]), []).append((ids[a:b][near], score[near]))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q, parts in found.items():                            # the best of this cell for each query
            vec, score = (np.concatenate(x) for x in zip(*parts))
            top = np.lexsort((vec, -score))
            top = top[first_of_each(vec[top])[:k]]                # a row may be here once for each table
            out.append((np.full(len(top), q), vec[top], score[top]))
        q, vec, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": q.astype(np.int64), "vec_id": vec.astype(np.int64), "score": score})

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            tables: int = 2, hashes: int = 5, width: float = 1.5, near: float = 0.4, success: float = 0.75,
            part_rows: int = 1024, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` rows of largest cosine
    among the visited buckets, ties to the smaller vec_id, its own id left out; all rows
    where there are no more than ``k``.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; vectors of other lengths are not compared. A repeated query
    id is one query (one of its vectors). Empty tables give an empty result."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col).filter(F.exists("v", lambda x: x != 0.0))
    asked = usable(queries, id_col, vector_col).filter(F.exists("v", lambda x: x != 0.0)).dropDuplicates(["vec_id"])

    def index(batches):
        for batch in batches:
            for ids, m, column in _by_length(batch):
                h, unit = Hasher(m.shape[1], tables, hashes, width, seed), _unit(m)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids), column, pa.array(h.buckets(t, unit)), pa.array(np.full(len(ids), t, np.int32))],
                        ["vec_id", "v", "bucket", "t"])

    def probe(share):
        def run(batches):
            for batch in batches:
                for ids, m, _ in _by_length(batch):
                    h, unit = Hasher(m.shape[1], tables, hashes, width, seed), _unit(m)
                    for i, u in zip(ids, unit):
                        for t in range(tables):
                            visited = h.probes(t, u, near, share)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(visited), i)), pa.array(visited)],
                                                             ["query_id", "bucket"])
        return run

    indexed = written(rows.mapInArrow(index, "vec_id long, v array<double>, bucket long, t int"), "ann-index")
    sizes = written(indexed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.first("t").alias("t"), F.first(F.size("v")).alias("dim"))
                    .withColumn("parts", F.ceil(F.col("n") / F.lit(part_rows)).cast("int")), "ann-sizes")
    total = sizes.agg(F.sum("n")).collect()[0][0] or 0
    cells = cells_for(total, 8192, spark)
    split = sizes.filter("parts > 1").select("bucket", "parts")
    split = F.broadcast(split) if split.count() <= 50_000 else split      # few rows, or a shuffle join
    one = F.coalesce("parts", F.lit(1))
    unit = F.xxhash64("bucket", "part").alias("unit")
    placed = indexed.join(split, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), one).cast("int")) \
        .select("vec_id", "v", unit).withColumn("cell", F.pmod("unit", F.lit(cells)))

    def searched(some: DataFrame, visits: DataFrame) -> DataFrame:
        visits = visits.join(split, "bucket", "left") \
            .select("query_id", "bucket", F.explode(F.sequence(F.lit(0), one - 1)).alias("part")) \
            .select("query_id", unit).withColumn("cell", F.pmod("unit", F.lit(cells)))
        # no more than the visited buckets of one query in a row
        lists = visits.groupBy("query_id", "cell").agg(F.collect_set("unit").alias("units")) \
            .join(some.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
        out = placed.groupBy("cell").cogroup(lists.groupBy("cell")).applyInArrow(
            lambda a, b: _measure(k)(a, b), "query_id long, vec_id long, score double")
        return written(best(out, k, "double"), "ann-found").drop("rank")

    asked = written(asked, "ann-asked")
    visited = "query_id long, bucket long"
    found = searched(asked, asked.mapInArrow(probe(success), visited))
    for share in (0.99, 0.9999, None):
        done = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= k)
        short = asked.join(done.withColumnRenamed("query_id", "vec_id"), "vec_id", "left_anti")
        if short.isEmpty():
            break
        if share is not None and share <= success:
            continue
        # every row is in one bucket of the first table
        wider = short.mapInArrow(probe(share), visited) if share is not None else \
            short.select(F.col("vec_id").alias("query_id"), F.size("v").alias("dim")) \
            .join(sizes.filter("t = 0").select("dim", "bucket"), "dim").select("query_id", "bucket")
        found = found.union(searched(short, wider))
    return best(found, k, "double")
