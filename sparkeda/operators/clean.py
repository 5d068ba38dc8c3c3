"""Cleaning (K1-K8): empty rows -> empty columns -> boolean words -> dates ->
duplicates -> names.

The cleaned schema depends on the data, so ``clean`` is two-phase: one
aggregate pass gathers every fact the rules need (after the empty-row filter),
then a single ``select`` applies all conversions. No per-column loop of jobs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean_value, is_blank, kind_of, q, strip
from ..functions.values import BOOLEAN_WORD_PAIRS, CATEGORICAL_WORDS, DATE_FORMATS
from ..session import spread


def _fields(df):
    return {f.name: f.dataType for f in df.schema.fields}


def empty_row_mask(df: DataFrame, strict: bool = False) -> Column:
    """True for rows to drop: all cells null, or all cells blank after trimming.
    A mix of null and blank is kept (the reference stringifies null as 'nan');
    ``strict=True`` drops such rows as well."""
    fields = _fields(df)
    cells = [clean_value(c, fields[c]) for c in df.columns]
    all_null = reduce(lambda a, b: a & b, [c.isNull() for c in cells])
    if strict:
        all_blank = reduce(lambda a, b: a & b, [c.isNull() | is_blank(c) for c in cells])
    else:
        all_blank = reduce(lambda a, b: a & b, [F.coalesce(is_blank(c), F.lit(False)) for c in cells])
    return all_null | all_blank


def drop_empty_rows(df: DataFrame, strict: bool = False) -> DataFrame:
    """K1: one filter expression, no Python per row."""
    return df.filter(~empty_row_mask(df, strict))


def _empty_columns(row, cols) -> list[str]:
    out = []
    for i, c in enumerate(cols):
        if row[f"e_n{i}"] == 0 or row[f"e_b{i}"] == row["__rows"]:
            out.append(c)
    return out


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """K2: drop columns that are all null or all blank (one aggregate)."""
    facts = clean_facts(df, [])
    return df.drop(*_empty_columns(facts, df.columns))


def _bool_columns(row, cols) -> dict[str, tuple[str, str]]:
    out = {}
    for i, c in enumerate(cols):
        if row[f"b_d{i}"] == 2:
            pair = {row[f"b_lo{i}"], row[f"b_hi{i}"]}
            for yes, no in BOOLEAN_WORD_PAIRS:
                if pair == {yes, no}:
                    out[c] = (yes, no)
    return out


def _bool_expr(c: str, yes: str, no: str) -> Column:
    w = F.lower(strip(q(c)))
    return F.when(w == yes, F.lit(1)).when(w == no, F.lit(0)).cast("int")


def parse_boolean_words(df: DataFrame) -> DataFrame:
    """K3: string columns holding exactly the two words {yes,no} or {true,false}
    (trimmed, any case, nulls aside) become 1/0; nulls stay null."""
    _, _, conv, _ = _decide(df, df, [])
    return df.select(*[_bool_expr(c, *conv[c]).alias(c) if c in conv else q(c) for c in df.columns])


def _looks_categorical(v: Column) -> Column:
    low = F.lower(v)
    return (low.isin(CATEGORICAL_WORDS)
            | ((F.length(v) < 15) & ~v.contains("/") & ~v.contains("-")
               & ~F.substring(v, 1, 4).rlike(r"\d")))


def format_shape(fmt: str) -> str:
    """A regex that every string a datetime pattern can parse must match; parsing
    is only tried on matching strings (a failed parse costs an exception)."""
    out, i = "^", 0
    tokens = [("yyyy", r"\d{4}"), ("SSSSSS", r"\d{6}"), ("SSS", r"\d{3}"), ("MMMM", "[A-Za-z]{3,9}"),
              ("MMM", "[A-Za-z]{3}"), ("MM", r"\d{2}"), ("M", r"\d{1,2}"), ("dd", r"\d{2}"), ("d", r"\d{1,2}"),
              ("HH", r"\d{2}"), ("H", r"\d{1,2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}"),
              ("XXX", r"(?:Z|[+-]\d{2}:\d{2})"), ("'T'", "T")]
    while i < len(fmt):
        for tok, rx in tokens:
            if fmt.startswith(tok, i):
                out += rx
                i += len(tok)
                break
        else:
            out += "\\" + fmt[i] if not fmt[i].isalnum() else fmt[i]
            i += 1
    return out + "$"


def parse_with(c: Column, fmt: str) -> Column:
    """``try_to_timestamp`` behind the cheap shape test."""
    return F.when(c.rlike(format_shape(fmt)), F.try_to_timestamp(c, F.lit(fmt)))


#: what the parts of a datetime pattern look like: 9 for each digit, a for each letter, | for a T
#: between digits, ~ for a Z behind the last one
_PART_SHAPES = [("yyyy", ["9999"]), ("SSSSSS", ["999999"]), ("SSS", ["999"]), ("MMMM", ["a" * k for k in range(3, 10)]), ("MMM", ["aaa"]),
                ("MM", ["99"]), ("M", ["9", "99"]), ("dd", ["99"]), ("d", ["9", "99"]), ("HH", ["99"]), ("H", ["9", "99"]), ("mm", ["99"]),
                ("ss", ["99"]), ("XXX", ["~", "+99:99", "-99:99"]), ("'T'", ["|"])]


def format_shapes(fmt: str) -> list[str]:
    """Every shape that a string of a datetime pattern can have."""
    shapes, i = [""], 0
    while i < len(fmt):
        part, looks = next(((p, x) for p, x in _PART_SHAPES if fmt.startswith(p, i)),
                           (fmt[i], ["a" if fmt[i].isalpha() else "9" if fmt[i].isdigit() else fmt[i]]))
        shapes = [s + x for s in shapes for x in looks]
        i += len(part)
    return shapes


def _loose(fmt: str) -> str:
    """The pattern with one-digit parts allowed, where no other digits touch them: on a string of
    the strict pattern's shape both say the same."""
    return re.sub(r"(?<![A-Za-z])(MM|dd|HH)(?![A-Za-z])", lambda m: m[0][0], fmt)


def with_dates(values: DataFrame, formats: list[str], name: str = "v") -> DataFrame:
    """``values`` plus ``dates``: (format number, year) for each pattern that parses the value.

    A dictionary of shapes, made from the patterns, says which of them can parse a value;
    patterns that differ only in allowing one digit count as one. So a value is parsed once (or
    twice, where the name of a month may be short or whole), and most values not at all."""
    loose = list(dict.fromkeys(map(_loose, formats)))
    by_shape: dict[str, dict[int, list[int]]] = {}
    for j, fmt in enumerate(formats):
        for shape in format_shapes(fmt):
            by_shape.setdefault(shape, {}).setdefault(loose.index(_loose(fmt)), []).append(j)
    none = F.array().cast("array<struct<j:int,y:int>>")
    if not formats:
        return values.withColumn("dates", none)
    v = q(name)
    shape = v
    for pattern, mark in (("[0-9]", "9"), ("(?<=9)T(?=9)", "|"), (r"(?<=9)Z\z", "~"), ("[A-Za-z]", "a")):
        shape = F.regexp_replace(shape, pattern, mark)
    shape = F.when(F.length(v) <= max(map(len, by_shape)), shape)
    listed = ", ".join("'" + x.replace("'", "''") + f"', array({', '.join(f'{g}' for g in groups)})" for x, groups in by_shape.items())
    out = values.withColumn("__shape", shape).withColumn("__g", F.expr(f"try_element_at(map({listed}), __shape)"))
    most = max(map(len, by_shape.values()))
    found = none
    credit = ", ".join(f"'{x.replace(chr(39), chr(39) * 2)}|{g}', array({', '.join(map(str, js))})"
                       for x, groups in by_shape.items() for g, js in groups.items())
    for k in range(most):
        g = F.get("__g", F.lit(k))
        year = None
        for i, fmt in enumerate(loose):
            parsed = F.year(F.try_to_timestamp(v, F.lit(fmt)))
            year = F.when(g == i, parsed) if year is None else year.when(g == i, parsed)
        out = out.withColumn(f"__y{k}", year).withColumn(f"__c{k}", F.expr(f"try_element_at(map({credit}), concat(__shape, '|', get(__g, {k})))"))
        own = F.expr(f"transform(__c{k}, j -> named_struct('j', j, 'y', __y{k}))")
        found = F.concat(found, F.when(F.col(f"__y{k}").isNotNull(), own).otherwise(none))
    return out.withColumn("dates", found).drop("__shape", "__g", *[f"__{x}{k}" for x in "yc" for k in range(most)])


def _date_columns(row, cols, formats, rows) -> dict[str, str]:
    """Pick, per column, the format with most parses; convert when it parses more
    than 80 % of all rows with years in [1900, 2100]. Low-cardinality columns
    (<= 10 distinct) holding a categorical-looking value are skipped."""
    out = {}
    for i, c in enumerate(cols):
        if row[f"t_d{i}"] <= 10 and row[f"t_c{i}"] > 0:
            continue
        best = max(range(len(formats)), key=lambda j: (row[f"t_n{i}_{j}"], -j))
        n = row[f"t_n{i}_{best}"]
        if rows and n / rows > 0.8:
            y0, y1 = row[f"t_y0{i}_{best}"], row[f"t_y1{i}_{best}"]
            if y0 is not None and y0 >= 1900 and y1 <= 2100:
                out[c] = formats[best]
    return out


def parse_datetime_columns(df: DataFrame, formats: list[str] | None = None,
                           skip: list[str] | None = None) -> DataFrame:
    """K4: string columns that parse as dates in > 80 % of all rows become timestamps."""
    formats = formats or DATE_FORMATS
    _, _, _, conv = _decide(df, df, formats)
    conv = {c: f for c, f in conv.items() if c not in (skip or [])}
    return df.select(*[parse_with(q(c), conv[c]).alias(c) if c in conv else q(c)
                       for c in df.columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """K5: full-row de-duplication (null equals null)."""
    return df.dropDuplicates()


def normalized_names(names: list[str]) -> list[str]:
    """strip, lower, space and '-' -> '_'; collisions get _1, _2, ... suffixes."""
    out, seen = [], {}
    for n in names:
        base = n.strip().lower().replace(" ", "_").replace("-", "_")
        name, k = base, 0
        while name in seen:
            k += 1
            name = f"{base}_{k}"
        seen[name] = True
        out.append(name)
    return out


def normalize_column_names(df: DataFrame) -> DataFrame:
    """K6: rename only (no data touched)."""
    return df.toDF(*normalized_names(df.columns))


def clean_facts(base: DataFrame, formats: list[str]) -> dict:
    """Every fact the cleaning rules read, in long form so that the generated
    code does not grow with the width: string columns are unpivoted and grouped
    to (column, distinct value, count) once -- parsing and word tests then run
    per distinct value, weighted by its count. Other columns only need their
    non-null counts."""
    fields = _fields(base)
    cols = base.columns
    texts = [i for i, c in enumerate(cols) if kind_of(fields[c]) == "string"]
    others = [i for i in range(len(cols)) if i not in texts]
    out: dict = {}
    head = base.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(clean_value(cols[i], fields[cols[i]])).alias(f"e_n{i}") for i in others]).collect()[0]
    out["__rows"] = head["__rows"]
    for i in others:
        out[f"e_n{i}"], out[f"e_b{i}"] = head[f"e_n{i}"], 0
    if not texts:
        return out
    long = base.select(F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), q(cols[i]).alias("v")) for i in texts])))
    vals = with_dates(long.groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n")), formats)
    v, n = F.col("v"), F.col("n")
    t = strip(v)
    word = F.lower(t)
    aggs = [F.sum(F.when(v.isNotNull(), n)).alias("nn"), F.sum(F.when(is_blank(v), n)).alias("blank"),
            F.count(v).alias("distinct"), F.count(F.when(_looks_categorical(t), 1)).alias("cat")]
    aggs += [F.count(F.when(word == w, 1)).alias(f"w_{w}") for pair in BOOLEAN_WORD_PAIRS for w in pair]
    for j in range(len(formats)):
        y = F.expr(f"get(filter(dates, d -> d.j = {j}), 0).y")
        aggs += [F.sum(F.when(y.isNotNull(), n)).alias(f"n{j}"), F.min(y).alias(f"y0{j}"), F.max(y).alias(f"y1{j}")]
    per = {r["pos"]: r for r in vals.groupBy("pos").agg(*aggs).collect()}
    for i in texts:
        r = per.get(i)
        out[f"e_n{i}"] = (r["nn"] or 0) if r else 0
        out[f"e_b{i}"] = (r["blank"] or 0) if r else 0
        out[f"t_d{i}"] = r["distinct"] if r else 0
        out[f"t_c{i}"] = r["cat"] if r else 0
        for j in range(len(formats)):
            out[f"t_n{i}_{j}"] = (r[f"n{j}"] or 0) if r else 0
            out[f"t_y0{i}_{j}"] = r[f"y0{j}"] if r else None
            out[f"t_y1{i}_{j}"] = r[f"y1{j}"] if r else None
        # two words that are all there is
        pair = next((p for p in BOOLEAN_WORD_PAIRS if r and all(r[f"w_{w}"] for w in p)
                     and sum(r[f"w_{w}"] for w in p) == r["distinct"]), None)
        out[f"b_d{i}"], out[f"b_lo{i}"], out[f"b_hi{i}"] = (2, *pair) if pair else (0, None, None)
    return out


def _by_position(facts: dict, cols: list[str], idx: list[int], prefix: tuple[str, ...]) -> dict:
    """Re-key per-position facts to the 0..k-1 numbering the rule helpers use."""
    out = {"__rows": facts["__rows"]}
    for k, i in enumerate(idx):
        for key, val in facts.items():
            for pre in prefix:
                if key == f"{pre}{i}" or key.startswith(f"{pre}{i}_"):
                    out[key.replace(f"{pre}{i}", f"{pre}{k}", 1)] = val
    return out


def _decide(df: DataFrame, base: DataFrame, formats: list[str]):
    facts = clean_facts(base, formats)
    fields = _fields(df)
    cols = df.columns
    texts = [i for i, c in enumerate(cols) if kind_of(fields[c]) == "string"]
    strings = [cols[i] for i in texts]
    empty = set(_empty_columns(facts, cols))
    sf = _by_position(facts, cols, texts, ("b_d", "b_lo", "b_hi", "t_d", "t_c", "t_n", "t_y0", "t_y1"))
    bools = _bool_columns(sf, strings)
    dates = _date_columns(sf, strings, formats, facts["__rows"])
    dates = {c: f for c, f in dates.items() if c not in bools}
    return facts["__rows"], empty, bools, dates


def clean(df: DataFrame, strict_empty_rows: bool = False, formats: list[str] | None = None) -> DataFrame:
    """K8: K1-K6 with every data-dependent decision taken from two aggregates over the
    non-empty rows (of counts, and of distinct texts); raises when nothing remains."""
    formats = formats or DATE_FORMATS
    base = spread(drop_empty_rows(df, strict_empty_rows), passes=3)
    rows, empty, bools, dates = _decide(df, base, formats)
    if rows == 0:
        raise ValueError("no rows left after removing empty rows")
    keep = [c for c in df.columns if c not in empty]
    if not keep:
        raise ValueError("no columns left after removing empty columns")
    exprs = []
    for c in keep:
        if c in bools:
            exprs.append(_bool_expr(c, *bools[c]).alias(c))
        elif c in dates:
            exprs.append(parse_with(q(c), dates[c]).alias(c))
        else:
            exprs.append(q(c))
    out = base.select(*exprs).dropDuplicates()
    return normalize_column_names(out)


def cleaning_plan(df: DataFrame, strict_empty_rows: bool = False, formats=None) -> DataFrame:
    """What ``clean`` decides, one row per input column: (column, action, detail)."""
    formats = formats or DATE_FORMATS
    base = drop_empty_rows(df, strict_empty_rows)
    _, empty, bools, dates = _decide(df, base, formats)
    names = normalized_names(df.columns)
    out = []
    for i, c in enumerate(df.columns):
        if c in empty:
            out.append((i, c, names[i], "drop_empty", None))
        elif c in bools:
            out.append((i, c, names[i], "boolean_words", "/".join(bools[c])))
        elif c in dates:
            out.append((i, c, names[i], "datetime", dates[c]))
        else:
            out.append((i, c, names[i], "keep", None))
    return df.sparkSession.createDataFrame(
        out, "position int, column string, new_name string, action string, detail string")
