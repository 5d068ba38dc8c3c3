"""Ad-hoc queries (Q1-Q3): SQL over a registered view, a structured query spec,
and fuzzy matching of values against a vocabulary."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import q
from ..session import cut_lineage
from .explore import apply_filters, page_in_order, paginate, top_n
from .stats import group_aggregate, scalar_result


_SELECT = re.compile(r"(select|with)\b", re.I)
_CHANGES = re.compile(r"\)\s*(insert|merge|update|delete)\b", re.I)
_TEXT = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def _named(statement: str, view: str, name: str) -> str:
    """The statement with the table name ``view`` replaced outside of texts and comments."""
    out, at = [], 0
    for m in [*_TEXT.finditer(statement), None]:
        end = m.start() if m else len(statement)
        out.append(re.sub(rf"(?<![\w.]){re.escape(view)}(?!\w)", name, statement[at:end], flags=re.I))
        if m:
            own = m.group()
            out.append(name if own.lower() == f"`{view}`".lower() else own)
            at = m.end()
    return "".join(out)


def run_sql(df: DataFrame, sql: str, page: int = 1, size: int = 50, view: str = "dataset",
            tiebreak: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q1: run a user SELECT against ``df`` under the table name ``dataset``; page the result in
    the order the statement gives it. Spark's parser and Catalyst do all the work; a
    trailing ';' is allowed, anything but a SELECT (or WITH ... SELECT) is rejected.
    The table stands under a name of its own while the statement is read, so a view that
    the session has under ``dataset`` stays as it is. ``tiebreak`` replaces the statement's
    order by an order on those columns."""
    statement = sql.strip().rstrip(";").strip()
    if not _SELECT.match(statement) or _CHANGES.search(_TEXT.sub("''", statement)):
        raise ValueError("only SELECT statements can be run")
    name = f"dataset_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        result = df.sparkSession.sql(_named(statement, view, name))
    finally:
        df.sparkSession.catalog.dropTempView(name)
    if tiebreak:
        return paginate(result, page, size, None, "asc", tiebreak)
    return page_in_order(result, page, size)


def run_query_spec(df: DataFrame, spec: dict) -> DataFrame:
    """Q2: structured query: {filters, group_by, aggs, scalar, sort_by, sort_order, limit}.
    Replaces model-written pandas code with declarative DataFrame calls."""
    out = apply_filters(df, spec.get("filters"))
    if spec.get("scalar"):
        return scalar_result(out, spec["scalar"])
    if spec.get("group_by"):
        out = group_aggregate(out, spec["group_by"], spec.get("aggs", {}))
    if spec.get("columns"):
        out = out.select(*[q(c) for c in spec["columns"]])
    sort_by, limit = spec.get("sort_by"), spec.get("limit")
    if sort_by and limit and spec.get("sort_order", "desc") == "desc":
        return top_n(out, sort_by, limit, spec.get("tiebreak"))
    if sort_by:
        col = q(sort_by)
        out = out.orderBy(col.asc_nulls_last() if spec.get("sort_order", "desc") == "asc" else col.desc_nulls_last(),
                          *[q(c) for c in spec.get("tiebreak", [])])
    if limit:
        out = out.limit(limit)
    return out


def _edit_budget(cutoff: float, la: Column, lb: Column) -> Column:
    """Largest edit distance t with 1 - t / max(la, lb) >= cutoff (a hair generous,
    so candidates are a superset; the final filter uses the exact score)."""
    return F.floor(F.lit(1.0 - cutoff) * F.greatest(la, lb) + F.lit(1e-9)).cast("int")


def _length_reach(length: Column, cutoff: float) -> Column:
    """Partner lengths L' that can reach similarity >= cutoff: |L - L'| <= edits
    <= (1 - c) max(L, L') means L' in [c L, L / c]."""
    lo = F.greatest(F.ceil(length * F.lit(cutoff) - F.lit(1e-9)), F.lit(0)).cast("int")
    hi = F.floor(length / F.lit(cutoff) + F.lit(1e-9)).cast("int")
    return F.sequence(lo, hi)


def _pieces(le: Column, t: Column, short: Column) -> tuple[Column, Column, Column]:
    """Even split of a length-``le`` string into t + 1 pieces: the piece numbers to
    explode (-1 alone for strings too short to cut), and the start and length of
    piece ``i`` as plain arithmetic (code-generated, no lambda)."""
    nums = F.when(short, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), t))
    def where(i: Column) -> tuple[Column, Column]:
        k = t + 1
        base, extra = F.floor(le / k).cast("int"), le % k
        ln = base + F.when(i >= k - extra, 1).otherwise(0)
        st = i * base + F.greatest(i - (k - extra), F.lit(0))
        return st, ln
    return nums, where


_RANK_TYPE = "struct<inexact:boolean,neg:double,entry:string>"


def match_to_vocabulary(df: DataFrame, col: str, vocab: DataFrame, vocab_col: str,
                        cutoff: float = 0.7, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Q3: map each distinct value of ``col`` to a vocabulary entry: its
    case-insensitive equal when there is one, else the most similar entry with
    similarity 1 - levenshtein / max(length) >= ``cutoff`` (ties: the smallest
    entry). Values without a match keep themselves (score NULL).

    Exact, without pairing every value with every entry. If an entry of length Le
    is within t edits of a value, then cut into t + 1 pieces one piece survives
    whole in the value, shifted by at most t (pigeonhole). So entries emit their
    pieces keyed by (value length, entry length, piece no, piece text), values
    emit their substrings at the reachable positions under the same key, and an
    equi-join yields the candidates (plus a join on lower() for case-insensitive
    equals). Only entries too short to cut (Le <= t, possible for cutoff <= 0.5)
    fall back to a join on the two lengths. Values emit keys only for entry
    lengths present in the vocabulary. The vocabulary's pieces are broadcast when
    their size is within ``broadcast_bytes``, so the many value keys are joined where they are
    made, without a shuffle; beyond that the join shuffles.
    The best entry per value is a grouped min, combined map-side.
    """
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("cutoff must be in (0, 1]")
    # both distinct lists are read by three branches below: written once to the
    # checkpoint folder instead of recomputing their scans and shuffles
    vals = cut_lineage(df.select(q(col).alias("value")).filter(F.col("value").isNotNull()).distinct())
    vocab = cut_lineage(vocab.select(q(vocab_col).alias("entry")).filter(F.col("entry").isNotNull()).distinct())

    # entries: (lv, le, i, piece) for every value length lv they can reach
    ent = (vocab.withColumn("le", F.length("entry"))
           .withColumn("lv", F.explode(_length_reach(F.col("le"), cutoff)))
           .withColumn("t", _edit_budget(cutoff, F.col("le"), F.col("lv"))))
    nums, where = _pieces(F.col("le"), F.col("t"), F.col("le") <= F.col("t"))
    ent_keys = ent.select("entry", "lv", "le", "t", F.explode(nums).alias("i"))
    st, ln = where(F.col("i"))
    ent_keys = ent_keys.select("entry", "lv", "le", "i",
                               F.when(F.col("i") >= 0, F.substring("entry", st + 1, ln))
                               .otherwise(F.lit("")).alias("piece"))

    # values: substrings at every position a piece can have moved to
    lengths = vocab.select(F.length("entry").alias("le")).distinct()
    v = (vals.withColumn("lv", F.length("value"))
         .withColumn("le", F.explode(_length_reach(F.col("lv"), cutoff)))
         .join(lengths, "le")
         .withColumn("t", _edit_budget(cutoff, F.col("le"), F.col("lv"))))
    nums, where = _pieces(F.col("le"), F.col("t"), F.col("le") <= F.col("t"))
    v = v.select("value", "lv", "le", "t", F.explode(nums).alias("i"))
    p, n = where(F.col("i"))
    v = v.withColumn("p", p).withColumn("n", n)
    # a piece kept whole at shift d leaves >= |d| edits before it and >= |D - d| after
    # it (D = lv - le), so |d| + |D - d| <= t: d in [-floor((t-D)/2), floor((t+D)/2)].
    # Taking the first piece (from the left) that is kept whole also bounds d by the
    # pieces on either side of it: d in [max(-i, D - (t - i)), min(i, D + (t - i))]
    dd = F.col("lv") - F.col("le")
    i, t = F.col("i"), F.col("t")
    d_lo = F.greatest(-F.floor((t - dd) / 2).cast("int"), -i, dd - (t - i))
    d_hi = F.least(F.floor((t + dd) / 2).cast("int"), i, dd + (t - i))
    lo = F.greatest(F.col("p") + d_lo, F.lit(0))
    hi = F.least(F.col("p") + d_hi, F.col("lv") - F.col("n"))
    starts = F.when(i < 0, F.array(F.lit(0))).when(lo <= hi, F.sequence(lo, hi)) \
        .otherwise(F.array().cast("array<int>"))
    v_keys = (v.select("value", "lv", "le", "i", "n", F.explode(starts).alias("st"))
              .select("value", "lv", "le", "i",
                      F.when(F.col("i") >= 0, F.substring("value", F.col("st") + 1, F.col("n")))
                      .otherwise(F.lit("")).alias("piece")))
    size = ent_keys.agg(F.sum(F.octet_length("entry") + F.octet_length("piece") + 64)).collect()[0][0] or 0
    small = size <= broadcast_bytes
    ent_side = F.broadcast(ent_keys) if small else ent_keys
    by_piece = v_keys.join(ent_side, ["lv", "le", "i", "piece"]).select("value", "entry")
    low = vocab.withColumn("k", F.lower("entry"))
    by_case = vals.withColumn("k", F.lower("value")).join(F.broadcast(low) if small else low, "k") \
        .select("value", "entry")

    # banded distance: gives up (-1) past the row's edit budget, which no match exceeds
    maxlen = F.greatest(F.length("value"), F.length("entry"))
    budget = _edit_budget(cutoff, F.length("value"), F.length("entry"))
    dist = F.call_function("levenshtein", F.col("value"), F.col("entry"), budget)
    sim = F.when(maxlen == 0, F.lit(1.0)).when(dist >= 0, 1.0 - dist / maxlen)
    exact = F.lower("value") == F.lower("entry")
    scored = (by_piece.unionByName(by_case).withColumn("score", sim).withColumn("exact", exact)
              .filter(F.col("exact") | (F.col("score") >= cutoff)))
    scored = scored.withColumn("score", F.when(F.col("exact") & F.col("score").isNull(),
                                               1.0 - F.levenshtein("value", "entry") / maxlen)
                               .otherwise(F.col("score")))
    # candidates may repeat (several pieces hit); the min below absorbs that, and a
    # NULL row per value keeps values without any candidate, so one grouped
    # aggregate (combined map-side) does dedup, ranking and the outer join at once
    rank = F.struct((~F.col("exact")).alias("inexact"), (-F.col("score")).alias("neg"),
                    F.col("entry").alias("entry"))
    none = vals.select("value", F.lit(None).cast(_RANK_TYPE).alias("b"))
    best = scored.select("value", rank.alias("b")).unionByName(none).groupBy("value").agg(F.min("b").alias("b"))
    return best.select("value", F.coalesce("b.entry", "value").alias("match"),
                       F.when(~F.col("b.inexact"), F.lit(1.0)).otherwise(-F.col("b.neg")).alias("score"))


def replace_with_vocabulary(df: DataFrame, col: str, vocab: DataFrame, vocab_col: str,
                            cutoff: float = 0.7) -> DataFrame:
    """Q3 applied: ``col`` replaced by its match (a join on the distinct values)."""
    m = match_to_vocabulary(df, col, vocab, vocab_col, cutoff).select(
        F.col("value").alias("__v"), F.col("match").alias("__m"))
    out = df.join(m, q(col) == F.col("__v"), "left")
    return out.withColumn(col, F.coalesce("__m", q(col))).drop("__v", "__m")



def _char_tokens(s: str) -> str:
    """SQL: the characters of a string, each with its how-many-eth occurrence."""
    chars = f"transform(sequence(1, length({s})), i -> substring({s}, i, 1))"
    return (f"case when length({s}) = 0 then array() else transform({chars}, (x, i) -> "
            f"concat(x, cast(size(filter(slice({chars}, 1, i + 1), y -> y = x)) as string))) end")


def _ratios(batches):
    """Ratcliff-Obershelp ratio of (value, entry) pairs: matched characters of the longest common
    block and, recursively, of what lies to its left and right, twice over all characters."""
    import pyarrow as pa
    from difflib import SequenceMatcher
    for batch in batches:
        values, entries = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        score, matcher, last = [], SequenceMatcher(), None
        for v, e in zip(values, entries):
            if v != last:                                         # what it keeps about its second text is reused
                matcher.set_seq2(v)
                last = v
            matcher.set_seq1(e)
            score.append(matcher.ratio())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], ["value", "entry", "score"])


def match_by_ratio(df: DataFrame, col: str, vocab: DataFrame, vocab_col: str, cutoff: float = 0.7) -> DataFrame:
    """Q3 with the ratio of close matches: each distinct value of ``col`` is mapped to its
    case-insensitive equal in the vocabulary (the least one), else to the entry of greatest ratio >=
    ``cutoff`` (ties: the greatest entry). Values without a match keep themselves (score NULL).

    Exact, without pairing every value with every entry. Matched characters are no more than the
    overlap of the two multisets of characters, so a ratio of c needs an overlap of
    o = c (lv + le) / 2. Characters, numbered by occurrence, are put in one order, rarest
    first; two strings that overlap in o of them share one among the first l - o + 1 of each.
    These are the keys of an equi-join (with both lengths); pairs whose whole overlap is
    large enough are measured."""
    if not 0.0 < cutoff <= 1.0:
        raise ValueError("cutoff must be in (0, 1]")
    vals = cut_lineage(df.select(q(col).alias("value")).filter(F.col("value").isNotNull()).distinct())
    entries = cut_lineage(vocab.select(q(vocab_col).alias("entry")).filter(F.col("entry").isNotNull()).distinct())
    sides = {}
    for name, strings in (("value", vals), ("entry", entries)):
        sides[name] = strings.filter(F.length(name) > 0).select(
            name, F.length(name).alias("own"), F.explode(F.expr(_char_tokens(name))).alias("token"))
    counts = sides["value"].select("token").union(sides["entry"].select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    reach = (F.lit(2.0) - cutoff) / cutoff                        # lengths differ by no more than this factor
    lengths = {name: s.select("own").distinct().withColumnRenamed("own", "other") for name, s in sides.items()}
    keys = {}
    for name, partner in (("value", "entry"), ("entry", "value")):
        ordered = sides[name].join(counts, "token").withColumn(
            "at", F.row_number().over(Window.partitionBy(name).orderBy("n", "token")))
        own, other = F.col("own"), F.col("other")
        pairs = sides[name].select("own").distinct().join(lengths[partner], (other <= own * reach + 1e-9) & (own <= other * reach + 1e-9)) \
            .withColumn("first", own - F.ceil(F.lit(cutoff / 2) * (own + other) - 1e-9) + 1).filter("first > 0")
        keys[name] = ordered.join(pairs, "own").filter("at <= first").select(name, "token", own.alias(f"l_{name}"), other.alias(f"l_{partner}"))
    found = keys["value"].join(keys["entry"], ["token", "l_value", "l_entry"]).select("value", "entry").distinct()
    overlap = F.size(F.array_intersect(F.expr(_char_tokens("value")), F.expr(_char_tokens("entry"))))
    found = found.filter(2.0 * overlap >= F.lit(cutoff) * (F.length("value") + F.length("entry")) - 1e-9)
    scored = found.mapInArrow(_ratios, "value string, entry string, score double").filter(F.col("score") >= cutoff)
    same = vals.withColumn("k", F.lower("value")).join(entries.withColumn("k", F.lower("entry")), "k") \
        .groupBy("value").agg(F.min("entry").alias("same"))
    best = scored.groupBy("value").agg(F.max(F.struct("score", "entry")).alias("b"))
    return vals.join(same, "value", "left").join(best, "value", "left").select(
        "value", F.coalesce("same", "b.entry", "value").alias("match"),
        F.when(F.col("same").isNotNull(), F.lit(1.0)).otherwise(F.col("b.score")).alias("score"))
