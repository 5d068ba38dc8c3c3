"""Pearson correlation (A1-A3): every pair in one scan, pairwise deletion.

A few columns take one aggregate with three moments for each pair. Wide tables take a blocked
Gram accumulation: each Arrow batch gives, by matrix products of the values (shifted by the
column's first value in the batch, so large means cost no digits) and of the null masks, the
count, means, squared deviations and co-deviations of all pairs; moments of batches, tasks and at
last of the whole table are merged pairwise. One scan serves any width.

A constant column (or one that is constant where the other is present) has no coefficient: NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import numeric_value, rnd

_FEW_PAIRS = 100           # pairs of one aggregate whose code stays small
_TASK_SLICES = 32          # partial merges of a column's moments
_MOMENTS = ("n", "mx", "my", "sx", "sy", "c")
_GRAM = "i int, slice int, " + ", ".join(f"{m} array<double>" for m in _MOMENTS)


def _pair_aggs(vals, pairs):
    aggs = []
    for k, (a, b) in enumerate(pairs):
        x, y = vals[a], vals[b]
        xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        aggs += [F.covar_samp(x, y).alias(f"c{k}"), F.stddev_samp(xm).alias(f"sx{k}"),
                 F.stddev_samp(ym).alias(f"sy{k}")]
    return aggs


def correlation_matrix(df: DataFrame, cols: list[str], few_pairs: int = _FEW_PAIRS) -> DataFrame:
    """A1: long form (col1, col2, corr) for every ordered pair, diagonal included
    (1 for a varying column, NULL for a constant one)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    vals = {c: numeric_value(c, fields[c]) for c in cols}
    upper = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    if len(upper) > few_pairs:
        return _by_gram(df.select(*[v.alias(f"v{i}") for i, v in enumerate(vals.values())]), list(vals))
    row = df.agg(*_pair_aggs(vals, upper))
    structs = []
    for k, (a, b) in enumerate(upper):
        if a == b:
            r = F.when(F.col(f"sx{k}") > 0, F.lit(1.0))
        else:
            r = F.try_divide(F.col(f"c{k}"), F.col(f"sx{k}") * F.col(f"sy{k}"))
            r = F.when(F.col(f"sx{k}") * F.col(f"sy{k}") > 0, r)
        structs.append(F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), r.alias("corr")))
        if a != b:
            structs.append(F.struct(F.lit(b).alias("col1"), F.lit(a).alias("col2"), r.alias("corr")))
    return row.select(F.inline(F.array(*structs)))


def _batch_moments(x: np.ndarray):
    """(n, mean x, mean y, x deviations, y deviations, co-deviations), each columns x columns, of
    a rows x columns block with NaN for missing; x is the row's column, y the other one."""
    there = ~np.isnan(x)
    first = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    z, m = np.where(there, x - first, 0.0), there.astype(np.float64)
    n = m.T @ m
    sums, squares, products = z.T @ m, (z * z).T @ m, z.T @ z
    some = np.maximum(n, 1)
    c = products - sums * sums.T / some
    dev = squares - sums * sums / some
    dev = np.where(dev > 1e-13 * squares, dev, 0.0)               # rounding of a constant
    mean = first[:, None] + sums / some
    return n, mean, mean.T, dev, dev.T, c


def _merged_moments(a, b):
    """Moments of two disjoint sets of rows together."""
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    share = b[0] / some
    dx, dy = b[1] - a[1], b[2] - a[2]
    both = a[0] * share
    # where one side is empty its means are no numbers of the data
    mx, my = (np.where(a[0] == 0, q, np.where(b[0] == 0, p, p + d * share)) for p, q, d in ((a[1], b[1], dx), (a[2], b[2], dy)))
    return (n, mx, my, a[3] + b[3] + dx * dx * both, a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both)


def _gram(batches):
    """A row per column with its moments against all columns, over a task's batches."""
    total = None
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            x = np.column_stack([np.asarray(c.cast(pa.float64()).fill_null(float("nan"))) for c in part.columns])
            x[~np.isfinite(x)] = np.nan
            total = _batch_moments(x) if total is None else _merged_moments(total, _batch_moments(x))
    if total is not None:
        yield _gram_rows(np.arange(len(total[0])), np.random.default_rng().integers(0, _TASK_SLICES), total)


def _gram_rows(i, part, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(np.full(len(i), part), pa.int32()), *(pa.array(list(m), pa.list_(pa.float64())) for m in total)],
        ["i", "slice", *_MOMENTS])


def _merge_column(rows: pa.Table) -> pa.Table:
    total = None
    for batch in rows.to_batches():
        for r in range(batch.num_rows):
            one = tuple(np.asarray(batch.column(m)[r].values) for m in _MOMENTS)
            total = one if total is None else _merged_moments(total, one)
    i = rows.column("i")[0].as_py()
    return pa.Table.from_batches([_gram_rows(np.array([i]), 0, [m[None, :] for m in total])])


def _by_gram(values: DataFrame, names: list[str]) -> DataFrame:
    part = values.mapInArrow(_gram, _GRAM)
    part = part.groupBy("i", "slice").applyInArrow(_merge_column, _GRAM).groupBy("i").applyInArrow(_merge_column, _GRAM)
    long = part.select("i", F.posexplode(F.arrays_zip(*_MOMENTS)).alias("j", "m")).select("i", "j", "m.*")
    label = F.array(*[F.lit(c) for c in names])
    spread = F.sqrt("sx") * F.sqrt("sy")
    # deviations within the rounding of the means are those of a constant
    varies = (F.sqrt(F.col("sx") / F.col("n")) > F.lit(1e-15) * F.abs("mx")) & (F.sqrt(F.col("sy") / F.col("n")) > F.lit(1e-15) * F.abs("my"))
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("c") / spread)
    found = long.filter("n > 1").select("i", "j", F.when(varies, r).alias("corr"))
    d = len(names)
    grid = values.sparkSession.range(d * d).select((F.col("id") / d).cast("int").alias("i"), (F.col("id") % d).cast("int").alias("j"))
    return grid.join(found, ["i", "j"], "left").select(F.get(label, F.col("i")).alias("col1"), F.get(label, F.col("j")).alias("col2"), "corr")


def usable_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with more than one distinct value and more than two values. The least and
    the greatest value differ exactly where there are several, so one aggregate does."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    vals = [numeric_value(c, fields[c]) for c in cols]
    row = df.agg(*[e for i, v in enumerate(vals) for e in
                   (F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.count(v).alias(f"n{i}"))]).collect()[0]
    return [c for i, c in enumerate(cols) if row[f"n{i}"] > 2 and row[f"a{i}"] != row[f"b{i}"]]


def usable_correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """A2: A1 over usable columns with missing coefficients filled by 0."""
    use = usable_columns(df, cols)
    if len(use) < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, corr double")
    m = correlation_matrix(df, use)
    return m.select("col1", "col2", F.coalesce("corr", F.lit(0.0)).alias("corr"))


def strong_correlations(df: DataFrame, cols: list[str], threshold: float = 0.5) -> DataFrame:
    """A3: upper-triangle pairs with |r| >= threshold, 3 dp, strength label, by |r| desc."""
    use = usable_columns(df, cols)
    if len(use) < 2:
        return df.sparkSession.createDataFrame([], "col1 string, col2 string, correlation double, strength string")
    pos = {c: i for i, c in enumerate(use)}
    m = correlation_matrix(df, use)
    order = F.create_map(*[x for c in use for x in (F.lit(c), F.lit(pos[c]))])
    m = m.withColumn("i", order[F.col("col1")]).withColumn("j", order[F.col("col2")])
    r = F.coalesce("corr", F.lit(0.0))
    return (m.filter((F.col("i") < F.col("j")) & (F.abs(r) >= threshold))
            .select("col1", "col2", rnd(r, 3).alias("correlation"),
                    F.when(r > 0, "Strong Positive").otherwise("Strong Negative").alias("strength"))
            .orderBy(F.desc(F.abs("correlation")), "col1", "col2"))
