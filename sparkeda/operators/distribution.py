"""Distributions and densities (D1-D8): bounds from one aggregate, then one
grouping job over binned values. Zero bins come from ``sequence`` over the
tiny bounds frame, never from a cross join of data.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bin_index, numeric_value, q, rnd, strip
from ..functions.values import NO_VALUE
from ..plans.quantiles import NumericFacts
from ..plans.ranking import rank_in_groups
from ..session import cut_lineage, spread


def _fields(df):
    return {f.name: f.dataType for f in df.schema.fields}


def _projected(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """The numeric value of each column computed once, in a projection that the
    later binning expressions only read (spread over the cores once when the
    scan is narrower than the cluster: bounds and counts read it twice)."""
    fields = _fields(df)
    names = {c: f"__v{i}" for i, c in enumerate(dict.fromkeys(cols))}
    base = spread(df.select(*[numeric_value(c, fields[c]).alias(n) for c, n in names.items()]), passes=2)
    return base, {c: F.col(n) for c, n in names.items()}


def few_distinct(df: DataFrame, most: int) -> dict[str, int]:
    """{column: distinct values} of the columns with at most ``most`` of them. Every task keeps
    a set of at most ``most`` + 1 values per column, and only those are shuffled."""
    names = df.columns

    def capped(batches):
        seen = [None] * len(names)
        for batch in batches:
            for i, c in enumerate(batch.columns):
                if seen[i] is None or len(seen[i]) <= most:
                    new = pc.unique(c.drop_null())
                    seen[i] = new if seen[i] is None else pc.unique(pa.concat_arrays([seen[i], new]))
                    seen[i] = seen[i].slice(0, most + 1)
        for i, values in enumerate(seen):
            if values is not None and len(values):
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), values.cast(pa.float64())], ["i", "v"])

    kept = df.select(*[q(c).cast("double").alias(c) for c in names]).mapInArrow(capped, "i int, v double").distinct()
    found = {names[r["i"]]: r["n"] for r in kept.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in names if found.get(c, 0) <= most}


def _bounds(df: DataFrame, vals: dict) -> dict:
    """Count, min, max and whole-number test per column."""
    aggs = []
    for i, c in enumerate(vals):
        v = vals[c]
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"),
                 F.count(F.when(v % 1 != 0, 1)).alias(f"f{i}")]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(vals):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        if lo is not None and lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        out[c] = {"n": row[f"n{i}"], "lo": lo, "hi": hi,
                  "integral": row[f"n{i}"] > 0 and row[f"f{i}"] == 0, "rows": row["__rows"]}
    return out


def _binned_counts(df, vals, spec) -> DataFrame:
    """(column, bin, count) with bin NULL for the missing bucket. ``spec``: column -> (lo, hi, bins)."""
    structs = []
    for c, (lo, hi, bins) in spec.items():
        v = vals[c]
        b = bin_index(v, lo, hi, bins) if lo is not None else F.lit(None).cast("int")
        structs.append(F.struct(F.lit(c).alias("column"), b.alias("bin")))
    long = df.select(F.inline(F.array(*structs)))
    return long.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))


def _bin_frame(spark, spec) -> DataFrame:
    rows = [(c, float(lo), float(hi), int(bins)) for c, (lo, hi, bins) in spec.items() if lo is not None]
    frame = spark.createDataFrame(rows, "column string, lo double, hi double, bins int")
    return frame.select("column", "lo", "hi", "bins",
                        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))


def histogram(df: DataFrame, cols: list[str], bins: int = 10, facts: NumericFacts | None = None) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed; a constant column
    uses [v - 0.5, v + 0.5]); zero bins kept; the null bucket is the row with
    ``bin`` NULL. Columns: column, bin, lower, upper, count."""
    if facts is None:
        df, vals = _projected(df, cols)
        bounds = {c: (b["lo"], b["hi"]) for c, b in _bounds(df, vals).items()}
    else:
        df, vals = facts.base, facts.values
        bounds = {c: (None, None) if m["min"] is None else (m["min"] - 0.5, m["max"] + 0.5) if m["min"] == m["max"] else (m["min"], m["max"])
                  for c, m in facts.moments.items()}
    return _assemble(df, vals, {c: (*bounds[c], bins) for c in cols})


def _assemble(df, vals, spec) -> DataFrame:
    counts = _binned_counts(df, vals, spec)
    grid = _bin_frame(df.sparkSession, spec)
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    full = (grid.join(F.broadcast(counts.filter(F.col("bin").isNotNull())), ["column", "bin"], "left")
            .select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))
    nulls = counts.filter(F.col("bin").isNull()).select(
        "column", "bin", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
        F.col("count").cast("long").alias("count"))
    return full.unionByName(nulls)


def distribution_histogram(df: DataFrame, cols: list[str], facts: NumericFacts | None = None) -> DataFrame:
    """A whole-number column with <= 60 distinct values gets one bar per value
    (label = the integer, plus ``No Value`` for missing); others get
    min(50, max(10, floor(sqrt(n)))) equal-width bins (label = bin number).
    Columns: column, label, lower, upper, count."""
    facts = facts or NumericFacts(df, cols, passes=3)
    df, vals, m = facts.base, facts.values, facts.moments
    whole = [c for c in dict.fromkeys(cols) if m[c]["n"] and not m[c]["broken"]]
    few = few_distinct(df.select(*[vals[c].alias(c) for c in whole]), 60) if whole else {}
    bar_cols = [c for c in cols if c in few]
    hist_cols = [c for c in cols if c not in bar_cols and m[c]["n"]]
    parts = []
    if bar_cols:
        structs = [F.struct(F.lit(c).alias("column"), vals[c].cast("long").cast("string").alias("label"))
                   for c in bar_cols]
        long = df.select(F.inline(F.array(*structs)))
        bars = (long.groupBy("column", F.coalesce("label", F.lit(NO_VALUE)).alias("label"))
                .agg(F.count(F.lit(1)).alias("count")))
        parts.append(bars.select("column", "label", F.when(F.col("label") != NO_VALUE, F.col("label").cast("double")).alias("lower"),
                                 F.when(F.col("label") != NO_VALUE, F.col("label").cast("double")).alias("upper"),
                                 F.col("count").cast("long")))
    if hist_cols:
        spec = {}
        for c in hist_cols:
            lo, hi = m[c]["min"], m[c]["max"]
            spec[c] = (*((lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)), min(50, max(10, int(math.sqrt(m[c]["n"])))))
        h = _assemble(df, vals, spec).filter(F.col("bin").isNotNull())
        parts.append(h.select("column", F.col("bin").cast("string").alias("label"), "lower", "upper", "count"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, label string, lower double, upper double, count bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bars_of_columns(df: DataFrame, cols: list[str], k: int | None = 30) -> DataFrame:
    """D3 for many columns: (column, label, count, rank). One scan counts every value of every
    column; bars and missing buckets are read off those counts. ``k`` None: all values."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), q(c).cast("string").alias("label")) for i, c in enumerate(cols)]
    counts = cut_lineage(df.select(F.inline(F.array(*cells))).groupBy("i", "column", "label").agg(F.count(F.lit(1)).alias("count")))
    v = F.col("label")
    missing = counts.filter(v.isNull() | (strip(v) == "")).groupBy("i", "column").agg(F.sum("count").alias("count"))
    values = counts.filter(v.isNotNull() & (v != "") & (F.lower(v) != "nan"))
    top = rank_in_groups(values, ["i", "column"], [F.desc("count"), F.col("label")], "rank", k)
    if k is None:
        last = values.groupBy("i", "column").agg((F.count(F.lit(1)) + 1).alias("rank"))
        missing = missing.join(last, ["i", "column"], "left").withColumn("rank", F.coalesce("rank", F.lit(1)))
    else:
        missing = missing.withColumn("rank", F.lit(k + 1))
    missing = missing.select("column", F.lit(NO_VALUE).alias("label"), F.col("count").cast("long").alias("count"), "rank")
    return top.select("column", "label", F.col("count").cast("long").alias("count"), "rank").unionByName(missing)


def shares_of_bars(bars: DataFrame, max_bars: int | None = 15) -> DataFrame:
    """D4 of ``bars_of_columns``: percent shares (2 dp) for columns of 2..``max_bars`` bars (None:
    any number from 2)."""
    w = Window.partitionBy("column")
    n = F.col("_n")
    return (bars.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_t", F.sum("count").over(w))
            .filter((n > 1) & (n <= max_bars) if max_bars is not None else n > 1)
            .select("column", "label", "count", rnd(F.col("count") * 100.0 / F.col("_t"), 2).alias("percent")))


def category_bars(df: DataFrame, col: str, k: int | None = 30) -> DataFrame:
    """D3: top ``k`` values (ties by value; None: all) plus ``No Value`` = nulls + cells blank
    after trimming. As in the reference, a whitespace-only cell counts both as
    missing and as a value (only the exact empty string is removed)."""
    return bars_of_columns(df, [col], k).drop("column")


def category_shares(df: DataFrame, col: str, k: int | None = 30, max_bars: int | None = 15) -> DataFrame:
    """Percent shares (2 dp) of the D3 bars when there are 2..``max_bars`` of them."""
    return shares_of_bars(bars_of_columns(df, [col], k), max_bars).drop("column")


def density_2d(df: DataFrame, x: str, y: str, bins: int = 20, min_rows: int = 10) -> DataFrame:
    """``bins`` x ``bins`` counts over the rows where both are present (left
    edges reported); empty when fewer than ``min_rows`` such rows."""
    return density_pairs(df, [x, y], bins=bins, min_rows=min_rows, pairs=[(x, y)])


def density_pairs(df: DataFrame, cols: list[str], bins: int = 20, min_rows: int = 10,
                  pairs: list[tuple[str, str]] | None = None, max_cols: int | None = None) -> DataFrame:
    """All pairs (i < j) of the columns, or of the first ``max_cols``: one bounds
    aggregate and one counting job for all pairs."""
    if pairs is None:
        cols = cols[:max_cols]
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    df, vals = _projected(df, [c for p in pairs for c in p])
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = vals[a].isNotNull() & vals[b].isNotNull()
        xa, yb = F.when(both, vals[a]), F.when(both, vals[b])
        aggs += [F.count(xa).alias(f"n{i}"), F.min(xa).alias(f"x0{i}"), F.max(xa).alias(f"x1{i}"),
                 F.min(yb).alias(f"y0{i}"), F.max(yb).alias(f"y1{i}")]
    row = df.agg(*aggs).collect()[0]
    spec = []
    for i, (a, b) in enumerate(pairs):
        if row[f"n{i}"] < min_rows:
            continue
        x0, x1, y0, y1 = row[f"x0{i}"], row[f"x1{i}"], row[f"y0{i}"], row[f"y1{i}"]
        if x0 == x1:
            x0, x1 = x0 - 0.5, x1 + 0.5
        if y0 == y1:
            y0, y1 = y0 - 0.5, y1 + 0.5
        spec.append((i, a, b, float(x0), float(x1), float(y0), float(y1)))
    spark = df.sparkSession
    if not spec:
        return spark.createDataFrame([], "x string, y string, x_bin int, y_bin int, x_left double, "
                                         "y_left double, count long")
    structs = []
    for i, a, b, x0, x1, y0, y1 in spec:
        both = vals[a].isNotNull() & vals[b].isNotNull()
        structs.append(F.struct(F.lit(i).alias("pair"),
                                F.when(both, bin_index(vals[a], x0, x1, bins)).alias("x_bin"),
                                F.when(both, bin_index(vals[b], y0, y1, bins)).alias("y_bin")))
    counts = (df.select(F.inline(F.array(*structs))).filter(F.col("x_bin").isNotNull())
              .groupBy("pair", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.createDataFrame([(i, a, b, x0, x1, y0, y1) for i, a, b, x0, x1, y0, y1 in spec],
                                 "pair int, x string, y string, x0 double, x1 double, y0 double, y1 double")
    seq = F.sequence(F.lit(0), F.lit(bins - 1))
    grid = grid.withColumn("x_bin", F.explode(seq)).withColumn("y_bin", F.explode(seq))
    out = grid.join(F.broadcast(counts), ["pair", "x_bin", "y_bin"], "left")
    return out.select("x", "y", "x_bin", "y_bin",
                      (F.col("x0") + F.col("x_bin") * ((F.col("x1") - F.col("x0")) / bins)).alias("x_left"),
                      (F.col("y0") + F.col("y_bin") * ((F.col("y1") - F.col("y0")) / bins)).alias("y_left"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


_KDE_TERMS = 21            # moments kept of each cell
_KDE_CELLS = 10            # cells a bandwidth


def kde_curve(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian kernel density on ``grid`` points spanning [min, max], Scott
    bandwidth h = sd * n^(-1/5).

    A fast Gauss transform: values fall into cells of a tenth of the bandwidth, and a cell keeps
    the sums of its first 21 powers, combined map-side, of t = (v - centre) / h. With
    u = (x - centre) / h the cell's part of the density at x is exp(-u^2 / 2) times the sum of
    He_m(u) sum(t^m) / m!, the Hermite series of all its kernels. As |t| <= 1/20 and kernels
    beyond |u| = 39 are zero in doubles, what the series leaves out is below 1e-12 of
    each kernel. So the work is cells x grid, however many distinct values there are."""
    v = numeric_value(col, _fields(df)[col])
    s = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"),
               F.max(v).alias("hi")).collect()[0]
    spark = df.sparkSession
    if not s["n"] or s["n"] < 2 or not s["sd"]:
        return spark.createDataFrame([], "column string, point int, x double, density double")
    n, h, lo = s["n"], s["sd"] * s["n"] ** (-0.2), s["lo"]
    step = (s["hi"] - lo) / (grid - 1)
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    at = (F.col("v") - F.lit(lo)) / F.lit(h)                      # in bandwidths from the least value
    cells = df.select(v.alias("v")).filter(F.col("v").isNotNull()).select(at.alias("at")) \
        .withColumn("centre", (F.floor(F.col("at") * _KDE_CELLS) + 0.5) / _KDE_CELLS).withColumn("t", F.col("at") - F.col("centre"))
    powers = [F.sum(F.pow("t", F.lit(m)) / math.factorial(m)).alias(f"m{m}") if m else F.count(F.lit(1)).cast("double").alias("m0")
              for m in range(_KDE_TERMS)]
    cells = cells.groupBy("centre").agg(*powers).select("centre", F.array(*[f"m{m}" for m in range(_KDE_TERMS)]).alias("moments"))
    # He_0 = 1, He_1 = u, He_(m+1) = u He_m - m He_(m-1)
    series = F.expr("aggregate(moments, named_struct('m', 0D, 'low', 0D, 'now', 1D, 'sum', 0D), (a, x) -> named_struct('m', a.m + 1, "
                    "'low', a.now, 'now', u * a.now - a.m * a.low, 'sum', a.sum + a.now * x), a -> a.sum)")
    points = F.posexplode(F.array(*[F.lit(k * step / h) for k in range(grid)])).alias("point", "place")
    return (cells.select("centre", "moments", points).withColumn("u", F.col("place") - F.col("centre"))
            .groupBy("point").agg(F.sum(F.when(F.abs("u") < 39, F.exp(-0.5 * F.col("u") * F.col("u")) * series).otherwise(F.lit(0.0))).alias("k"))
            .select(F.lit(col).alias("column"), F.col("point").cast("int").alias("point"),
                    (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), (F.col("k") * F.lit(norm)).alias("density")))
