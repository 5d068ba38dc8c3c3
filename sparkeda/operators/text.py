"""Text jobs over a column of documents (X1-X6), all row-local except where a
document's own lines are numbered.

Regex flavour: the rules were written for Python's ``re``. Java's ``\\s`` and
``.`` differ from Python's, so patterns spell Python's whitespace set out and
use UNIX_LINES (``(?d)``) so that only ``\\n`` ends a line, as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import WS_CHARS, q, strip  # noqa: F401
from ..plans.ranking import top_n_per_group
from ..session import spread

# Python's str whitespace (what re's \s and str.strip() use), as a class body.
WS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x9F]"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (a character-set trim, no regex)."""
    return strip(c)


# characters the rules delete outright (no regex needed: ``translate``)
CONTROL_CHARS = "".join(chr(x) for x in list(range(0x00, 0x09)) + [0x0B, 0x0C] + list(range(0x0E, 0x20))
                        + list(range(0x7F, 0xA0)))


def _markdown_common(c: Column) -> Column:
    # each step reads the previous one once: in projections that hold lambdas
    # Spark evaluates without common-subexpression reuse, so no step may
    # reference its input twice
    c = F.regexp_replace(c, r"[*`]", "")
    c = F.regexp_replace(c, f"(?md)^#{{1,6}}[{WS}]+", "")
    return F.regexp_replace(c, r"(?d)__(.+?)__", "$1")


def strip_markdown_expr(c: Column) -> Column:
    """X1 on one column: code fences, '*', backticks, '#' headers, __x__,
    >= 3 newlines -> 2, runs of spaces -> 1, then strip."""
    c = F.regexp_replace(c, r"```[\p{L}\p{N}_]*\n?", "")
    c = F.regexp_replace(c, "```", "")
    c = _markdown_common(c)
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, " {2,}", " ")
    return F.coalesce(strip_ws(c), F.lit(""))


def clean_generated_text_expr(c: Column) -> Column:
    """X2 on one column: control characters and CR dropped, markdown removed,
    bullets normalised to '• ', blank-line runs collapsed, then strip."""
    c = F.regexp_replace(c, CONTROL, "")
    c = F.regexp_replace(c, "\r", "")
    c = _markdown_common(c)
    c = F.regexp_replace(c, f"(?md)^[{WS}]*[-*+][{WS}]+", "• ")
    c = F.regexp_replace(c, f"\\n[{WS}]*\\n[{WS}]*\\n+", "\n\n")
    c = F.regexp_replace(c, f"\\n[{WS}]+•", "\n•")
    return F.coalesce(strip_ws(c), F.lit(""))


def strip_markdown(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """X1."""
    return spread(df).withColumn(out or col, strip_markdown_expr(q(col)))


def clean_generated_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """X2."""
    return spread(df).withColumn(out or col, clean_generated_text_expr(q(col)))


def bullets_expr(c: Column, max_bullets: int = 10) -> Column:
    """X3 as an array: clean, split lines, strip, drop empties and leading bullet
    marks; a line over 200 characters holding '.' is split into sentences after
    [.!?] + whitespace; the first ``max_bullets`` pieces. Row-local (no shuffle).

    Every line left non-empty after the mark is removed yields at least one
    piece, so only the first ``max_bullets`` such lines are split: the same
    result without sentence-splitting the rest of a long text."""
    text = clean_generated_text_expr(c)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip_ws(x)), lambda x: x != "")
    lines = F.transform(lines, lambda x: F.when(F.substring(x, 1, 1).isin("•", "-", "*", "+"),
                                                F.regexp_replace(x, f"^[•\\-*+][{WS}]*", "")).otherwise(x))
    lines = F.slice(F.filter(lines, lambda x: x != ""), 1, max_bullets)
    sep = "\u0001"

    def pieces(x):
        sentences = F.filter(F.transform(F.split(F.regexp_replace(x, f"([.!?])[{WS}]+", "$1" + sep), sep),
                                         lambda s: strip_ws(s)), lambda s: s != "")
        return F.when((F.length(x) > 200) & x.contains("."), sentences).otherwise(F.array(x))

    return F.slice(F.flatten(F.transform(lines, pieces)), 1, max_bullets)


def to_bullets(df: DataFrame, col: str, key: str, max_bullets: int = 10) -> DataFrame:
    """One row per bullet (key, bullet_no 1.., n_bullets, bullet)."""
    arr = bullets_expr(q(col), max_bullets)
    return (spread(df.select(q(key).alias(key), q(col))).select(q(key).alias(key), arr.alias("_b"))
            # outer explode: an inner one makes Catalyst infer size(_b) > 0 below
            # the projection, which would compute the whole array twice
            .select(key, F.size("_b").alias("n_bullets"), F.posexplode_outer("_b").alias("pos", "bullet"))
            .filter(F.col("bullet").isNotNull())
            .select(key, (F.col("pos") + 1).alias("bullet_no"), "n_bullets", "bullet"))


def split_halves(bullets: DataFrame, key: str) -> DataFrame:
    """Bullets in two groups; the first takes the odd one (ceil(n / 2))."""
    mid = F.floor(F.col("n_bullets") / 2) + F.col("n_bullets") % 2
    return bullets.withColumn("half", F.when(F.col("bullet_no") <= mid, 1).otherwise(2))


def parse_sections(df: DataFrame, col: str, key: str) -> tuple[DataFrame, DataFrame]:
    """X4: 'SECTION:' header lines (any case) own the following '-' / '•' items.
    Items before the first header are dropped; text without a header gives
    nothing. Returns (sections: key, section_no, title, n_items;
    items: key, section_no, item_no, item). Lines are numbered per document,
    so a window only ever spans one document's lines."""
    lines = (df.select(q(key).alias(key), F.posexplode(F.split(q(col), "\n")).alias("line_no", "raw"))
             .withColumn("line", strip_ws(F.col("raw"))).filter(F.col("line") != ""))
    is_head = F.upper("line").startswith("SECTION:")
    is_item = F.col("line").startswith("-") | F.col("line").startswith("•")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = (lines.withColumn("is_head", is_head)
              .withColumn("section_no", F.sum(F.col("is_head").cast("int")).over(w))
              .filter(F.col("section_no") > 0))
    heads = tagged.filter("is_head").select(
        key, "section_no", strip_ws(F.expr("substring(line, instr(line, ':') + 1)")).alias("title"))
    items = (tagged.filter(~F.col("is_head") & is_item)
             .withColumn("item", strip_ws(F.regexp_replace("line", "^[-•]+", "")))
             .filter(F.col("item") != ""))
    iw = Window.partitionBy(key, "section_no").orderBy("line_no")
    items = items.withColumn("item_no", F.row_number().over(iw)).select(key, "section_no", "item_no", "item")
    counts = items.groupBy(key, "section_no").agg(F.count(F.lit(1)).alias("n_items"))
    sections = (heads.join(counts, [key, "section_no"], "left")
                .select(key, "section_no", "title", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items")))
    return sections, items


def recent_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, n: int = 5) -> DataFrame:
    """The last ``n`` entries of each conversation, in order, rendered as
    'role: text' lines (one row per conversation). Hot conversations are cut
    to n rows per salt slice before the per-conversation window."""
    last = top_n_per_group(df.select(conv, turn, role, text), [conv], [F.col(turn).desc()], n,
                           salt_on=[turn])
    lines = last.select(conv, F.struct(F.col(turn).alias("t"),
                                       F.concat_ws(": ", F.col(role), F.col(text)).alias("line")).alias("s"))
    g = lines.groupBy(conv).agg(F.array_sort(F.collect_list("s")).alias("ss"))  # <= n per group
    return g.select(conv, F.size("ss").alias("turns"),
                    F.array_join(F.transform("ss", lambda s: s["line"]), "\n").alias("context"))
