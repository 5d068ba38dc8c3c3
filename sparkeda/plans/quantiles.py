"""Exact quantiles (pandas ``linear`` / SQL ``quantile_cont``) without gathering a
column into one task, and the numeric facts that share them.

Spark's exact ``percentile`` merges a value->count map of the whole column in a
single task, which does not survive a column of billions of distinct values.
Here the wanted ranks of all columns sit in one state table (a row for each column and
rank, so bounded by the schema) and are located by narrowing passes over the unpivoted
(column, value) frame. A pass counts the values of every open bracket in ``buckets``
equal-width buckets, or by value once a bracket holds at most ``final_size`` of them; running
sums per bracket, still on the executors, pick the bucket that holds each rank; and just
that row per rank comes back as the next bracket. A hot value holding a third of the
rows collapses to a one-value bracket and costs nothing extra. The expressions of a pass look their
bracket up by column number, so their size does not grow with the number of columns.
``method="approx"`` uses ``percentile_approx`` (one pass).
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import numeric_value, q
from ..session import spread

_INF = float("inf")


def _rank_targets(n: int, p: float):
    pos = p * (n - 1)
    lo = int(math.floor(pos))
    hi = min(lo + 1, n - 1)
    return lo, hi, pos - lo


def unpivoted(df: DataFrame, values: list[Column]) -> DataFrame:
    """(i, v): the number of each value expression and its value, a narrow explode."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])))


def by_column(numbers: list[float | None]) -> Column:
    """The number at place ``i`` of a list that holds one for every column."""
    listed = ", ".join("cast(null as double)" if x is None else f"double('{x!r}')" for x in numbers)
    return F.expr(f"get(array({listed}), i)")


def _extremes(long: DataFrame) -> dict[int, dict]:
    """Per column: number of values, of infinite ones, least and greatest finite value."""
    v = F.col("v")
    finite = F.when(F.abs(v) < F.lit(_INF), v)
    rows = long.groupBy("i").agg(F.count(v).alias("n"), F.count(F.when(v == F.lit(-_INF), 1)).alias("below"),
                                 F.count(F.when(v == F.lit(_INF), 1)).alias("above"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    return {r["i"]: r.asDict() for r in rows.collect()}


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float],
                    buckets: int = 4096, final_size: int = 20000,
                    method: str = "exact", accuracy: int = 100000,
                    known: dict[str, tuple] | None = None) -> dict[tuple[str, float], float | None]:
    """{(name, p): quantile} for each named value expression and probability.
    ``known`` may pass (count, min, max) per name when an earlier aggregate has
    them, which saves the first pass (unless some value is infinite)."""
    names = list(values)
    if not names:
        return {}
    # evaluate each value expression once, in a projection below the passes
    flat = df.select(*[values[c].alias(f"__q{i}") for i, c in enumerate(names)])
    long = unpivoted(flat, [F.col(f"__q{i}") for i in range(len(names))])
    if method == "approx":
        rows = long.groupBy("i").agg(F.percentile_approx("v", list(probs), accuracy).alias("q")).collect()
        found = {r["i"]: r["q"] for r in rows}
        return {(c, p): None if found.get(i) is None else float(found[i][j])
                for i, c in enumerate(names) for j, p in enumerate(probs)}
    stats = None
    if known is not None and all(c in known for c in names):
        stats = {i: {"n": known[c][0], "below": 0, "above": 0, "lo": known[c][1], "hi": known[c][2]} for i, c in enumerate(names)}
    if stats is None or any(x is not None and math.isinf(x) for s in stats.values() for x in (s["lo"], s["hi"])):
        stats = _extremes(long)
    found: dict[tuple[int, int], float] = {}
    state: dict[tuple[int, int], dict] = {}
    wanted: dict[tuple[int, float], tuple | None] = {}
    for i in range(len(names)):
        s = stats[i]
        for p in probs:
            if not s["n"]:
                wanted[i, p] = None
                continue
            wanted[i, p] = _rank_targets(s["n"], p)
            for r in wanted[i, p][:2]:
                if r < s["below"] or r >= s["n"] - s["above"]:    # infinities are ranked by their counts
                    found[i, r] = -_INF if r < s["below"] else _INF
                else:
                    state[i, r] = {"lo": float(s["lo"]), "hi": float(s["hi"]), "below": s["below"],
                                   "size": s["n"] - s["below"] - s["above"], "exact": False}
    while True:
        for k in [k for k, s in state.items() if s["lo"] == s["hi"]]:
            found[k] = state.pop(k)["lo"]
        if not state:
            break
        for s in state.values():
            s["exact"] = s["exact"] or s["size"] <= final_size
        _narrow(long, len(names), state, buckets)
    out = {}
    for (i, p), t in wanted.items():
        if t is None:
            out[names[i], p] = None
            continue
        a, b = found[i, t[0]], found[i, t[1]]
        out[names[i], p] = a if a == b or t[2] == 0 else a * (1.0 - t[2]) + b * t[2]
    return out


def _narrow(long: DataFrame, n_columns: int, state: dict, buckets: int) -> None:
    """One pass: every open rank's bracket becomes the bucket, or the value, that holds it."""
    slots: dict[int, list[tuple]] = {}
    for (i, _), s in state.items():
        b = (s["lo"], s["hi"], s["exact"])
        if b not in slots.setdefault(i, []):
            slots[i].append(b)                                    # the brackets of a column are disjoint
    v, slot, bucket = F.col("v"), F.lit(None).cast("int"), F.lit(None).cast("double")
    for k in range(max(map(len, slots.values()))):
        here = [slots[i][k] if k < len(slots.get(i, ())) else None for i in range(n_columns)]
        lo, hi = (by_column([None if h is None else h[j] for h in here]) for j in (0, 1))
        # widths by hand: the difference of the ends may overflow, or vanish between neighbours
        width = [None if h is None else (h[1] - h[0]) / buckets for h in here]
        wide = [w is not None and math.isinf(w) for w in width]
        width = [h[1] / buckets - h[0] / buckets if far else w for h, w, far in zip(here, width, wide)]
        start = by_column([None if h is None else h[0] / w if far and w else None for h, w, far in zip(here, width, wide)])
        w = by_column([x if x else None for x in width])
        step = F.coalesce(v / w - start, (v - lo) / w, F.when(v > lo, F.lit(buckets - 1.0)).otherwise(F.lit(0.0)))
        own = F.when(by_column([None if h is None or not h[2] else 1.0 for h in here]).isNotNull(), v) \
            .otherwise(F.greatest(F.least(F.floor(step).cast("double"), F.lit(buckets - 1.0)), F.lit(0.0)))
        inside = (v >= lo) & (v <= hi)
        slot = F.when(inside, F.lit(k)).otherwise(slot)
        bucket = F.when(inside, own).otherwise(bucket)
    counts = long.select("i", slot.alias("slot"), bucket.alias("bucket"), "v").filter("slot is not null") \
        .groupBy("i", "slot", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    order = Window.partitionBy("i", "slot").orderBy("bucket")
    upto = counts.withColumn("upto", F.sum("n").over(order))      # at most max(buckets, final_size) rows a bracket
    ranks = long.sparkSession.createDataFrame(
        [(i, slots[i].index((s["lo"], s["hi"], s["exact"])), rank, s["below"]) for (i, rank), s in state.items()],
        "i int, slot int, rank long, below long")
    held = upto.join(F.broadcast(ranks), ["i", "slot"]).filter("rank >= below + upto - n and rank < below + upto")
    for r in held.select("i", "rank", "mn", "mx", "n", (F.col("below") + F.col("upto") - F.col("n")).alias("below")).collect():
        s = state[r["i"], r["rank"]]
        # a pass that does not shrink the bracket: the next one goes by value
        stuck = (float(r["mn"]), float(r["mx"]), r["n"]) == (s["lo"], s["hi"], s["size"])
        s.update(lo=float(r["mn"]), hi=float(r["mx"]), below=r["below"], size=r["n"], exact=s["exact"] or stuck)


class NumericFacts:
    """What statistics, outliers, boxes and histograms of the same columns share: the numeric
    values once in a projection (spread over the cores and written once where the scan is
    narrower than the cluster), one grouped aggregate of moments, one search for the quartiles and
    one count outside the fences. Each is made when first asked for, in long form, so the number
    of scans and the size of the code do not grow with the number of columns."""

    def __init__(self, df: DataFrame, cols: list[str], method: str = "exact", passes: int = 4):
        fields = {f.name: f.dataType for f in df.schema.fields}
        self.cols, self.method = list(dict.fromkeys(cols)), method
        self.base = spread(df.select(*[numeric_value(c, fields[c]).alias(f"__v{i}") for i, c in enumerate(self.cols)]), passes=passes)
        self.values = {c: F.col(f"__v{i}") for i, c in enumerate(self.cols)}
        self.long = unpivoted(self.base, list(self.values.values()))
        self._outside: dict[tuple, dict] = {}

    @cached_property
    def moments(self) -> dict[str, dict]:
        """rows, n, mean, std (sample), min, max, g1, g2 (population skewness and excess
        kurtosis) and whether all values are whole, per column."""
        rows = self.long.groupBy("i").agg(
            F.count(F.lit(1)).alias("rows"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"),
            F.count(F.when(F.col("v") % 1 != 0, 1)).alias("broken")).collect()
        found = {r["i"]: r.asDict() for r in rows}
        none = {"rows": 0, "n": 0, "broken": 0, **dict.fromkeys(("mean", "std", "min", "max", "g1", "g2"))}
        return {c: found.get(i, none) for i, c in enumerate(self.cols)}

    @cached_property
    def quartiles(self) -> dict[str, tuple]:
        """(q25, median, q75) per column."""
        known = {c: (m["n"], m["min"], m["max"]) for c, m in self.moments.items()}
        qs = exact_quantiles(self.base, self.values, [0.25, 0.5, 0.75], method=self.method, known=known)
        return {c: tuple(qs[c, p] for p in (0.25, 0.5, 0.75)) for c in self.cols}

    @cached_property
    def fences(self) -> dict[str, tuple]:
        """(lower, upper) fence per column; (None, None) without values."""
        out = {}
        for c, (q1, _, q3) in self.quartiles.items():
            out[c] = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        return out

    def outside(self, z: float | None = 3.0, by_quartiles: bool = True) -> dict[str, dict]:
        """Per column, one job: values outside the fences (``iqr``), with |z score| above ``z``
        (``zscore``; none where the deviation is 0), and the ends of the whiskers."""
        if (z, by_quartiles) in self._outside:
            return self._outside[z, by_quartiles]
        v, m = F.col("v"), self.moments
        lower, upper = (by_column([self.fences[c][j] for c in self.cols] if by_quartiles else [None] * len(self.cols)) for j in (0, 1))
        mean, std = (by_column([m[c][k] or None if k == "std" else m[c][k] for c in self.cols]) for k in ("mean", "std"))
        far = F.abs((v - mean) / std) > z if z is not None else F.lit(False)
        rows = self.long.groupBy("i").agg(
            F.count(F.when((v < lower) | (v > upper), 1)).alias("iqr"), F.count(F.when(far, 1)).alias("zscore"),
            F.min(F.when(v >= lower, v)).alias("low"), F.max(F.when(v <= upper, v)).alias("high")).collect()
        found = {r["i"]: r.asDict() for r in rows}
        none = {"iqr": 0, "zscore": 0, "low": None, "high": None}
        self._outside[z, by_quartiles] = {c: found.get(i, none) for i, c in enumerate(self.cols)}
        return self._outside[z, by_quartiles]


__all__ = ["NumericFacts", "by_column", "exact_quantiles", "q", "unpivoted"]
