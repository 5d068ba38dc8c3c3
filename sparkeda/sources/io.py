"""Sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import q, strip
from ..functions.values import IMAGE_SUFFIXES, NA_TOKENS
from ..session import cut_lineage

_INT_RE = r"^\s*[+-]?\d{1,38}\s*$"
_FLOAT_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: Quoted fields may hold quotes (doubled), line breaks and blanks at their ends.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}
_TRUE, _FALSE = ["True", "TRUE", "true"], ["False", "FALSE", "false"]


def _normalise_nan(df: DataFrame) -> DataFrame:
    """NaN -> NULL in float columns (Spark counts NaN as a value, pandas does not)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(~F.isnan(q(f.name)), q(f.name)).alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def infer_csv_types(df: DataFrame, na_tokens=NA_TOKENS, refuse_empty: bool = False) -> DataFrame:
    """All-string frame -> typed frame: NA tokens become NULL, then each column becomes
    long / decimal(38, 0) / double / boolean when every non-null value fits, else stays string.
    Whole numbers that a long cannot hold stay exact as decimals. One aggregate decides all
    columns; one select applies it. ``refuse_empty``: a frame without rows is an error."""
    tokens = list(na_tokens)
    nulled = df.select(*[F.when(~strip(q(c)).isin(tokens) & ~q(c).isin(tokens), q(c)).alias(c)
                         for c in df.columns])
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        v = q(c)
        whole = v.rlike(_INT_RE)
        aggs += [F.count(v).alias(f"n{i}"), F.count(F.when(whole, 1)).alias(f"i{i}"),
                 F.count(F.when(whole, strip(v).try_cast("long"))).alias(f"l{i}"),
                 F.count(F.when(v.rlike(_FLOAT_RE), 1)).alias(f"f{i}"),
                 F.count(F.when(v.isin(_TRUE + _FALSE), 1)).alias(f"b{i}")]
    row = nulled.agg(*aggs).collect()[0]
    if refuse_empty and not row["rows"]:
        raise ValueError("the table is empty")
    exprs = []
    for i, c in enumerate(df.columns):
        n, v = row[f"n{i}"], q(c)
        if n and row[f"i{i}"] == n:
            exprs.append(strip(v).cast("long" if row[f"l{i}"] == n else "decimal(38,0)").alias(c))
        elif n and row[f"f{i}"] == n:
            exprs.append(strip(v).cast("double").alias(c))
        elif n and row[f"b{i}"] == n:
            exprs.append(v.isin(_TRUE).alias(c))
        else:
            exprs.append(v.alias(c))
    return nulled.select(*exprs)


def has_line_breaks_in_fields(spark: SparkSession, path: str) -> bool:
    """Some line holds an odd number of quotes, as lines do where a quoted field goes on
    on the next one. One pass over splits of the files."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def read_table(spark: SparkSession, path: str, fmt: str | None = None, na_tokens=NA_TOKENS,
               schema=None, multi_line: bool | None = None, allow_empty: bool = False) -> DataFrame:
    """CSV (header, reader-style type inference, missing tokens) or parquet,
    chosen by suffix unless ``fmt`` is given. Other suffixes are rejected, and so are tables
    without rows unless ``allow_empty``. CSV files are read in splits; only where a quoted field holds a
    line break (looked up when ``multi_line`` is None) is a file read by one task."""
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if fmt == "csv":
        if multi_line is None:
            multi_line = has_line_breaks_in_fields(spark, path)
        reader = spark.read.options(**_CSV).option("multiLine", multi_line).option("mode", "PERMISSIVE")
        if schema is None:
            return infer_csv_types(reader.option("inferSchema", False).csv(path), na_tokens, not allow_empty)
        out = _normalise_nan(reader.schema(schema).csv(path))
    elif fmt == "parquet":
        out = _normalise_nan(spark.read.parquet(path))
    else:
        raise ValueError(f"unsupported file type: {fmt!r} (csv or parquet)")
    if not allow_empty and out.isEmpty():
        raise ValueError("the table is empty")
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: export with a header row (one file per task; no index column)."""
    df.write.mode(mode).options(**_CSV).csv(path)


def null_to_display(df: DataFrame) -> DataFrame:
    """Every value as text, NULL shown as the empty string."""
    return df.select(*[F.coalesce(q(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in an explicit order (top-k, no full sort), for display."""
    return null_to_display(df.orderBy(*[q(c) for c in order_by]).limit(n))


def dataset_inventory(spark: SparkSession, directory: str, names: list[str] | None = None) -> DataFrame:
    """(dataset, rows, columns) for each parquet table of a folder; counts come
    from parquet footers, so nothing but metadata is read."""
    if names is None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(directory)  # any store that Spark reads
        listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = sorted(f[:-8] for f in (s.getPath().getName() for s in listed) if f.endswith(".parquet"))
    parts = []
    for nm in names:
        t = spark.read.parquet(f"{directory.rstrip('/')}/{nm}.parquet")
        parts.append(t.groupBy().count().select(F.lit(nm).alias("dataset"),
                                                F.col("count").cast("long").alias("rows"),
                                                F.lit(len(t.columns)).cast("long").alias("columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_rows(df: DataFrame, n: int, seed: int = 42, keys: list[str] | None = None,
                total: int | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows when there are fewer).

    Rows are ranked by a seeded MD5 of ``keys`` (all columns by default);
    the ``n`` smallest hashes win. A hash threshold chosen from the row count
    first cuts each task to ~n/tasks candidates, so the final top-n merge sees
    about n rows, not n per task.
    """
    keys = keys or df.columns
    total = df.count() if total is None else total
    if total <= n:
        return df
    h = F.md5(F.concat_ws("|", *[q(k).cast("string") for k in keys], F.lit(f"sample{seed}")))
    frac = min(1.0, n / total * 1.05 + 8.0 * (n ** 0.5) / total)
    cand = df.withColumn("__h", h)
    if frac < 1.0:
        pre = cand.filter(F.col("__h") < F.lit(f"{int(frac * 16 ** 15):015x}"))
        if pre.count() >= n:
            cand = pre
    return cand.orderBy("__h", *[q(k) for k in keys]).limit(n).drop("__h")


def with_global_index(df: DataFrame, order: list, name: str = "__idx") -> DataFrame:
    """0-based position of each row in ``order`` without a single-task window.

    The rows are range-sorted and checkpointed once; counts and rows then read that one
    frame. (Sorting twice would not do: the two branches sample their range bounds and
    coalesce their partitions independently.)"""
    return number_rows(df.orderBy(*order), name)


def number_rows(ordered: DataFrame, name: str = "__idx") -> DataFrame:
    """0-based position of each row of a frame in the order it already has: partition
    numbers and row numbers are checkpointed with the rows, per-partition counts (one row
    per partition) become offsets by a running sum and are broadcast back."""
    s = cut_lineage(ordered.withColumn("__pid", F.spark_partition_id())
                    .withColumn("__mid", F.monotonically_increasing_id()))
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    out = s.join(F.broadcast(offsets.select("__pid", "__off", "__first")), "__pid")
    return out.withColumn(name, (F.col("__off") + F.col("__mid") - F.col("__first")).cast("long")) \
        .drop("__pid", "__mid", "__off", "__first")


def downsample_ordered(df: DataFrame, order: list[str], max_rows: int, total: int | None = None) -> DataFrame:
    """Every ``step``-th row in ``order``, step = max(1, n // max_rows); as in
    the reference this keeps up to 2*max_rows-1 rows. No-op when n <= max_rows."""
    total = df.count() if total is None else total
    if total <= max_rows:
        return df
    step = max(1, total // max_rows)
    if step == 1:
        return df
    idx = with_global_index(df, [q(c) for c in order])
    return idx.filter(F.col("__idx") % step == 0).drop("__idx")


def _be(c: str, at, n: int) -> str:
    """SQL: the big-endian number of ``n`` bytes from place ``at`` (0-based) of binary ``c``."""
    return f"cast(conv(hex(substring({c}, {at} + 1, {n})), 16, 10) as bigint)"


def _le(c: str, at, n: int) -> str:
    parts = [f"{_be(c, f'({at}) + {i}', 1)} * {256 ** i}" for i in range(n)]
    return "(" + " + ".join(parts) + ")"


def _size(width: str, height: str, channels: str) -> str:
    return f"named_struct('width', cast({width} as int), 'height', cast({height} as int), 'channels', cast({channels} as int))"


def _jpeg(c: str) -> str:
    """SQL: walk over the segments up to the frame header, as many as there can be bytes for."""
    frame = "x.m between 192 and 207 and x.m not in (196, 200, 204)"
    alone = "x.m = 1 or x.m between 208 and 217"
    step = (f"case when a.done then a else transform(array(named_struct('m', {_be(c, 'a.at + 1', 1)}, 'l', {_be(c, 'a.at + 2', 2)})), "
            f"x -> case when x.m is null or {_be(c, 'a.at', 1)} <> 255 then named_struct('at', a.at, 'done', true, 'hit', false) "
            f"when x.m = 255 then named_struct('at', a.at + 1, 'done', false, 'hit', false) "
            f"when {frame} then named_struct('at', a.at, 'done', true, 'hit', true) "
            f"when {alone} then named_struct('at', a.at + 2, 'done', false, 'hit', false) "
            f"else named_struct('at', a.at + 2 + x.l, 'done', false, 'hit', false) end)[0] end")
    walk = (f"aggregate(sequence(1, least(4096, length({c}))), named_struct('at', cast(2 as bigint), 'done', false, 'hit', false), "
            f"(a, i) -> {step})")
    found = _size(_be(c, "s.at + 7", 2), _be(c, "s.at + 5", 2), _be(c, "s.at + 9", 1))
    return f"transform(array({walk}), s -> case when s.hit then {found} end)[0]"


def _tiff(c: str) -> str:
    """SQL: width, height and samples a pixel from the first directory, in the file's byte order."""
    def number(at: str, n: int) -> str:
        return f"case when substring({c}, 1, 1) = X'49' then {_le(c, at, n)} else {_be(c, at, n)} end"

    def value(tag: int) -> str:
        found = (f"filter(transform(sequence(0, greatest(d.n, 1) - 1), i -> named_struct('t', {number('d.at + 2 + 12 * i', 2)}, "
                 f"'v', case when {number('d.at + 4 + 12 * i', 2)} = 3 then {number('d.at + 10 + 12 * i', 2)} "
                 f"else {number('d.at + 10 + 12 * i', 4)} end)), e -> e.t = {tag})")
        return f"get({found}, 0).v"

    at = number("4", 4)
    return (f"transform(transform(array({at}), o -> named_struct('at', o, 'n', {number('o', 2)})), "
            f"d -> {_size(value(256), value(257), f'coalesce({value(277)}, 1)')})[0]")


def image_headers(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with width, height and channels read off the first bytes of each image file, in
    column expressions; no pixel is decoded. PNG, GIF, BMP, JPEG, WebP and TIFF; null for
    anything else and for files that end too early. Palettes count as one channel."""
    c = "`" + content.replace("`", "``") + "`"
    head = f"hex(substring({c}, 1, 16))"
    png = _size(_be(c, 16, 4), _be(c, 20, 4), f"element_at(map(0, 1, 2, 3, 3, 1, 4, 2, 6, 4), cast({_be(c, 25, 1)} as int))")
    gif = _size(_le(c, 6, 2), _le(c, 8, 2), "1")
    bits = _le(c, 28, 2)
    tall = _le(c, 22, 4)
    bmp = _size(_le(c, 18, 4), f"case when {tall} >= 2147483648 then 4294967296 - {tall} else {tall} end", f"case when {bits} <= 8 then 1 else 3 end")
    webp = (f"case hex(substring({c}, 13, 4)) when '56503820' then {_size(f'{_le(c, 26, 2)} & 16383', f'{_le(c, 28, 2)} & 16383', '3')} "
            f"when '5650384C' then {_size(f'({_le(c, 21, 4)} & 16383) + 1', f'(shiftright({_le(c, 21, 4)}, 14) & 16383) + 1', f'case when shiftright({_le(c, 21, 4)}, 28) & 1 = 1 then 4 else 3 end')} "
            f"when '56503858' then {_size(f'{_le(c, 24, 3)} + 1', f'{_le(c, 27, 3)} + 1', f'case when {_be(c, 20, 1)} & 16 = 16 then 4 else 3 end')} end")
    found = (f"case when {head} like '89504E470D0A1A0A%' then {png} when {head} like '474946383_61%' then {gif} "
             f"when {head} like '424D%' then {bmp} when {head} like 'FFD8FF%' then {_jpeg(c)} "
             f"when {head} like '52494646________57454250%' then {webp} "
             f"when {head} like '49492A00%' or {head} like '4D4D002A%' then {_tiff(c)} end")
    sized = df.withColumn("__size", F.expr(found))
    whole = F.col("__size.width").isNotNull() & F.col("__size.height").isNotNull()
    return sized.select(*[q(x) for x in df.columns], *[F.when(whole, F.col(f"__size.{x}")).alias(x) for x in ("width", "height", "channels")])


def read_images(spark: SparkSession, directory: str, with_size: bool = False) -> DataFrame:
    """Image files under class folders (suffix allow-list), with their class
    label (parent folder, ``__root__`` for files at the top), path relative to
    the set (``relpath``) and byte length. ``with_size=True`` adds width, height and
    channels from the files' headers."""
    root = directory.rstrip("/")
    pattern = "(?i).*(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("path").rlike(pattern))
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _escape(root.lstrip("/")) + "/", "")
    parts = F.split(rel, "/")
    files = files.select("path", "length", *(["content"] if with_size else []), rel.alias("relpath"),
                         F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("__root__")).alias("label"))
    return image_headers(files).drop("content") if with_size else files


def _escape(s: str) -> str:
    import re
    return re.escape(s)
