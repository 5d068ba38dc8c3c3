"""Text queries (X1-X6) over whole documents, with DuckDB (RE2) twins."""

from __future__ import annotations

from ..operators import text as tx
from ..registry import register, table
from ..sources import derived as dv
from ._sql import with_views

WS = tx.WS
CONTROL = tx.CONTROL


def s_strip(e):
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"  # RE2 twin of the Spark trim


def s_rr(e, pat, rep):
    return f"regexp_replace({e}, '{pat}', '{rep}', 'g')"


def s_common(e):
    e = s_rr(e, r"[*`]", "")
    e = s_rr(e, f"(?m)^#{{1,6}}[{WS}]+", "")
    return s_rr(e, r"__(.+?)__", r"\1")


def s_markdown(e):
    e = s_rr(e, r"```[\p{L}\p{N}_]*\n?", "")
    e = s_rr(e, "```", "")
    e = s_common(e)
    e = s_rr(e, r"\n{3,}", "' || chr(10) || chr(10) || '")
    e = s_rr(e, " +", " ")
    return f"coalesce({s_strip(e)}, '')"


def s_clean(e):
    e = s_rr(e, CONTROL, "")
    e = s_rr(e, r"\r", "")
    e = s_common(e)
    e = s_rr(e, f"(?m)^[{WS}]*[-*+][{WS}]+", "• ")
    e = s_rr(e, f"\\n[{WS}]*\\n[{WS}]*\\n+", "' || chr(10) || chr(10) || '")
    e = s_rr(e, f"\\n[{WS}]+•", "' || chr(10) || '•")
    return f"coalesce({s_strip(e)}, '')"


def s_bullets(e, n=10):
    lines = f"list_filter(list_transform(string_split({s_clean(e)}, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> '')"
    lines = f"list_transform({lines}, lambda x: regexp_replace(x, '^[•\\-*+][{WS}]*', ''))"
    sent = (f"list_filter(list_transform(string_split(regexp_replace(x, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda s: {s_strip('s')}), lambda s: s <> '')")
    pieces = f"CASE WHEN length(x) > 200 AND contains(x, '.') THEN {sent} ELSE list_filter([x], lambda s: s <> '') END"
    return f"flatten(list_transform({lines}, lambda x: {pieces}))[1:{n}]"


register("strip_markdown_documents", f"SELECT doc_id, {s_markdown('text')} AS text FROM documents")(
    lambda spark, sf: tx.strip_markdown(table(spark, sf, "documents").select("doc_id", "text"), "text"))
register("strip_markdown_pages", f"SELECT page_id, {s_markdown('html')} AS html FROM pages")(
    lambda spark, sf: tx.strip_markdown(table(spark, sf, "pages").select("page_id", "html"), "html"))
register("clean_text_documents", f"SELECT doc_id, {s_clean('text')} AS text FROM documents")(
    lambda spark, sf: tx.clean_generated_text(table(spark, sf, "documents").select("doc_id", "text"), "text"))
register("clean_text_conversations", f"SELECT conv_id, turn, {s_clean('text')} AS text FROM conversations")(
    lambda spark, sf: tx.clean_generated_text(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text"))

_BUL = f"""b AS (SELECT doc_id, {s_bullets('text')} AS bl FROM documents),
u AS (SELECT doc_id, len(bl) AS n_bullets, unnest(bl) AS bullet, unnest(generate_series(1, len(bl))) AS bullet_no FROM b)"""
register("to_bullets_documents", f"WITH {_BUL}\nSELECT doc_id, CAST(bullet_no AS INTEGER) AS bullet_no, "
         "CAST(n_bullets AS INTEGER) AS n_bullets, bullet FROM u")(
    lambda spark, sf: tx.to_bullets(table(spark, sf, "documents"), "text", "doc_id"))
register("split_halves_documents", f"WITH {_BUL}\nSELECT doc_id, CAST(bullet_no AS INTEGER) AS bullet_no, "
         "CAST(n_bullets AS INTEGER) AS n_bullets, bullet, CASE WHEN bullet_no <= n_bullets // 2 + n_bullets % 2 "
         "THEN 1 ELSE 2 END AS half FROM u")(
    lambda spark, sf: tx.split_halves(tx.to_bullets(table(spark, sf, "documents"), "text", "doc_id"), "doc_id"))

_SEC = with_views("doc_sections") + f""",
l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no,
             unnest(string_split(text, chr(10))) AS raw FROM doc_sections),
l2 AS (SELECT doc_id, line_no, {s_strip('raw')} AS line FROM l),
t AS (SELECT *, upper(line) LIKE 'SECTION:%' AS is_head,
             sum(CASE WHEN upper(line) LIKE 'SECTION:%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_no
      FROM l2 WHERE line <> ''),
it AS (SELECT doc_id, section_no, line_no, {s_strip("regexp_replace(line, '^[-•]+', '')")} AS item FROM t
       WHERE section_no > 0 AND NOT is_head AND (line LIKE '-%' OR line LIKE '•%')),
it2 AS (SELECT doc_id, section_no, CAST(row_number() OVER (PARTITION BY doc_id, section_no ORDER BY line_no) AS INTEGER) AS item_no,
               item FROM it WHERE item <> '')"""
register("parse_sections_items", _SEC + "\nSELECT doc_id, CAST(section_no AS BIGINT) AS section_no, item_no, item FROM it2")(
    lambda spark, sf: tx.parse_sections(dv.doc_sections(spark, sf), "text", "doc_id")[1])
register("parse_sections_titles", _SEC + f"""
SELECT t.doc_id, CAST(t.section_no AS BIGINT) AS section_no, {s_strip("substr(t.line, instr(t.line, ':') + 1)")} AS title,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_items
FROM t LEFT JOIN (SELECT doc_id, section_no, count(*) AS n FROM it2 GROUP BY 1, 2) c
  ON t.doc_id = c.doc_id AND t.section_no = c.section_no WHERE t.is_head""")(
    lambda spark, sf: tx.parse_sections(dv.doc_sections(spark, sf), "text", "doc_id")[0])
_RAW = _SEC.replace(with_views("doc_sections") + ",", "WITH ").replace("FROM doc_sections", "FROM documents")
register("parse_sections_raw_documents", _RAW + "\nSELECT doc_id, CAST(section_no AS BIGINT) AS section_no, item_no, item FROM it2")(
    lambda spark, sf: tx.parse_sections(table(spark, sf, "documents"), "text", "doc_id")[1])

register("recent_turns_conversations", """SELECT conv_id, CAST(count(*) AS INTEGER) AS turns,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id""")(
    lambda spark, sf: tx.recent_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 5))
