"""Personal data (operator 7): patterns, and information-theoretic sanitisation.

Only DataFrame and SQL functions. E-mail addresses, IPs, cards and phones are found by
patterns (the base). They are the protected entities; words that stand beside them are
then weighed by corpus co-occurrence: with p(e) the share of distinct texts that hold the
entity e and p(e|t) the share of the texts with term t in which t stands beside e, a term
discloses e when

    PMI(e; t) = log p(e|t) / p(e)  >=  disclosure * IC(e),   IC(e) = -log p(e),

that is when knowing t removes at least that part of the information content of e. Such
terms are spans too (kind ``term``), wherever they occur, and are generalised. With
``whole_texts`` every word of a text that holds e is weighed, whatever its length, by a
p(e|t) drawn towards p(e) the more the rarer e is; the queries do so (``_whole_text_terms``).

Patterns use possessive quantifiers and start only at the edge of a run (or where the last
match ended), which gives the same leftmost matches in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import written

KINDS = ("email", "ip", "card", "phone")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Texts without a match of these cannot hold the kind.
_HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
_WORD = r"\p{L}++"
_BLOCK = 64
_KEY = "unhex(md5(cast({} as binary)))"
_SPAN = "array<struct<s:int,e:int,m:string>>"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL for all matches with their places in code points. Lengths are summed up in
    blocks, so texts with very many matches stay near linear."""
    p = _quote(pattern)
    pairs = (f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), "
             "(a, b) -> named_struct('g', length(a), 'l', length(b), 'm', b))")
    # the last piece has no match behind it: zip_with pads with null, which is dropped
    pairs = f"filter({pairs}, x -> x.m is not null)"
    blocks = (f"transform(array({pairs}), v -> transform(sequence(0, greatest(size(v) - 1, 0) div {_BLOCK}), "
              f"k -> slice(v, k * {_BLOCK} + 1, {_BLOCK})))[0]")
    pair_t = "struct<g:int,l:int,m:string>"
    placed = (f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<struct<at:int,b:array<{pair_t}>>>)), "
              "(acc, b) -> named_struct('at', acc.at + aggregate(b, 0, (n, x) -> n + x.g + x.l), "
              "'out', concat(acc.out, array(named_struct('at', acc.at, 'b', b)))), acc -> acc.out)")
    return (f"flatten(transform({placed}, k -> aggregate(k.b, named_struct('at', k.at, 'out', cast(array() as {_SPAN})), "
            "(acc, x) -> named_struct('at', acc.at + x.g + x.l, 'out', concat(acc.out, array(named_struct("
            "'s', acc.at + x.g, 'e', acc.at + x.g + x.l, 'm', x.m)))), acc -> acc.out)))")


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string is a multiple of ten."""
    total = (f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> "
             "case when i % 2 = 0 then cast(d as int) when cast(d as int) >= 5 then 2 * cast(d as int) - 9 "
             "else 2 * cast(d as int) end), 0, (n, x) -> n + coalesce(x, 0))")
    return f"{total} % 10 = 0"


def _valid(kind: str, m: str) -> str:
    """SQL: a match ``m`` of the pattern is one of the kind."""
    if kind == "ip":
        return (rf"forall(split({m}, '\\.'), p -> length(ltrim('0', p)) <= 3 and "
                "coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)")
    if kind == "card":
        d = f"regexp_replace({m}, '[ -]', '')"
        return f"length({d}) between 16 and 19 and {_luhn(d)}"
    if kind == "phone":
        return f"length(regexp_replace({m}, '[^0-9]', '')) between 8 and 15"
    return "true"


def _base(kind: str, text: str) -> str:
    """SQL: valid matches of one kind in ``text``."""
    return (f"case when {text} rlike {_quote(_HINTS[kind])} then filter({_matches(text, _PATTERNS[kind])}, "
            f"x -> {_valid(kind, 'x.m')}) else cast(array() as {_SPAN}) end")


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` plus one array of (s, e, m) per kind, columns ``__email`` and so on."""
    return df.select("*", *[F.expr(_base(k, f"`{text_col}`")).alias(f"__{k}") for k in KINDS])


def _beside(kind: str, text: str, chars: int, words: int) -> str:
    """SQL: (entity, words beside it) for each valid match of a kind."""
    p = _quote(_PATTERNS[kind])
    pieces = f"transform(split({text}, {p}, -1), a -> named_struct('h', left(a, {chars}), 't', right(a, {chars})))"
    near = (f"transform(concat(slice(reverse(regexp_extract_all(v.a[i].t, {_quote(_WORD)}, 0)), 1, {words}), "
            f"slice(regexp_extract_all(v.a[i + 1].h, {_quote(_WORD)}, 0), 1, {words})), w -> lower(w))")
    pairs = (f"transform(array(named_struct('a', {pieces}, 'm', regexp_extract_all({text}, {p}, 0))), v -> "
             f"transform(v.m, (m, i) -> named_struct('entity', m, 'terms', {near})))[0]")
    return (f"case when {text} rlike {_quote(_HINTS[kind])} then filter({pairs}, x -> {_valid(kind, 'x.entity')}) "
            "else cast(array() as array<struct<entity:string,terms:array<string>>>) end")


def disclosing_terms(df: DataFrame, text_col: str = "text", disclosure: float = 0.9, support: int = 3,
                     letters: int = 4, context_words: int = 4, context_chars: int = 100,
                     whole_texts: bool = False, prior: float = 0.5) -> DataFrame:
    """(term, entity, texts, disclosure) of terms that disclose a protected entity.

    Counts are over distinct texts of the whole corpus, so exact copies add no evidence;
    a pair needs ``support`` texts. Words of fewer than ``letters`` letters are left
    alone. With ``whole_texts`` neither these two nor the context bound what is weighed:
    see ``_whole_text_terms``. The frame is checkpointed."""
    rows = df.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    if whole_texts:
        return _whole_text_terms(rows, disclosure, prior)[0]
    entities = rows.select(F.expr("md5(cast(text as binary))").alias("key"), F.explode(F.flatten(F.array(
        *[F.expr(_beside(k, "text", context_chars, context_words)) for k in KINDS]))).alias("x")) \
        .select("key", F.lower("x.entity").alias("entity"), "x.terms")
    seen = cut_lineage(entities)
    beside = seen.select("key", "entity", F.explode(F.array_distinct("terms")).alias("term")) \
        .filter(F.length("term") >= letters).distinct()
    pairs = beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    per_entity = seen.groupBy("entity").agg(F.count_distinct("key").alias("of_entity"))
    texts = rows.agg(F.count_distinct(F.expr("md5(cast(text as binary))")).alias("n")).collect()[0]["n"]
    # a term stands in at least the texts in which it is beside any entity, which bounds its
    # disclosure from above: common words drop out before the corpus is counted
    near_any = beside.groupBy("term").agg(F.count_distinct("key").alias("near_any"))
    measure = "case when p_e >= 1.0 then 0.0 else ln(least(1.0, both / {}) / p_e) / -ln(p_e) end"
    pairs = pairs.join(per_entity, "entity").join(near_any, "term") \
        .withColumn("p_e", F.col("of_entity") / F.lit(float(max(texts, 1)))) \
        .filter(F.expr(measure.format("near_any")) >= disclosure).select("entity", "term", "both", "p_e")
    pairs = cut_lineage(pairs)
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        return pairs.select("term", "entity", F.col("both").alias("texts"), F.lit(0.0).alias("disclosure"))
    hits = _texts_with(rows, terms)
    of_term = hits.groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    scored = pairs.join(of_term, "term").withColumn("disclosure", F.expr(measure.format("of_term")))
    return cut_lineage(scored.filter(F.col("disclosure") >= disclosure)
                       .select("term", "entity", F.col("both").alias("texts"), "disclosure"))


def _whole_text_terms(rows: DataFrame, disclosure: float, prior: float) -> tuple[DataFrame, DataFrame | None]:
    """(term, entity, texts, disclosure) over all words, outside the entities, of the distinct
    texts that hold an entity, and (key, term) of the texts that hold a word which was weighed.

    p(e|t) is drawn towards p(e) by prior * IC(e) texts: (both + w p(e)) / (of_term + w) with
    w = prior * IC(e). Besides the part of the information content it must reach one half, so the
    texts that are needed grow with the logarithm of the corpus, and a word that met an
    entity once or twice is no evidence however large the corpus is. Entities that stand in exactly the
    same texts are weighed as one (under the smallest of them), so that a text with very
    many entities gives each of its words once, not once for each entity."""
    spans = "concat(" + ",".join(f"coalesce(__{k}, cast(array() as {_SPAN}))" for k in KINDS) + ")"
    blocks = _merged(f"transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 'l', x.e - x.s, 'k', '1'))")
    hinted = rows.filter(" or ".join(f"text rlike {_quote(h)}" for h in _HINTS.values()))
    found = base_spans(hinted).filter(F.expr(f"size({spans}) > 0")) \
        .withColumn("entities", F.expr(f"array_distinct(transform({spans}, x -> lower(x.m)))")) \
        .withColumn("__blocks", F.expr(blocks)) \
        .withColumn("outside", F.expr(_replaced("text", "__blocks")))
    words = f"array_distinct(regexp_extract_all(lower(outside), {_quote(_WORD)}, 0))"
    held = written(found.select(F.expr(_KEY.format("text")).alias("key"), "entities", F.expr(words).alias("words"))
                   .dropDuplicates(["key"]), "pii-held")
    n = rows.select(F.expr(_KEY.format("text"))).distinct().count()
    content = "-ln(p_e)"
    weight = f"({prior!r} * {content})"
    least = f"greatest(pow(p_e, {1.0 - disclosure!r}), 0.5D)"
    entities = held.select("key", F.explode("entities").alias("entity"))
    # with t beside e in all texts of e: the most texts with t at which it can still disclose e
    per_entity = entities.groupBy("entity").agg(
        F.count(F.lit(1)).alias("of_entity"), F.expr("bit_xor(xxhash64(key))").alias("mark"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("marks")) \
        .withColumn("p_e", F.col("of_entity") / F.lit(float(max(n, 1)))).filter("p_e < 1.0") \
        .withColumn("most", F.expr(f"(of_entity + {weight} * p_e) / {least} - {weight} + 1e-6")).filter("of_entity <= most")
    same = ["of_entity", "mark", "marks"]
    groups = per_entity.groupBy(*same).agg(F.min("entity").alias("first"), F.first("p_e").alias("p_e"), F.first("most").alias("most"))
    keys = written(entities.join(per_entity.select("entity", *same), "entity").select("key", *same).distinct()
                   .join(groups, same).select("key", F.col("first").alias("entity"), "p_e", "most"), "pii-entities")
    none = rows.sparkSession.createDataFrame([], "term string, entity string, texts bigint, disclosure double")
    if keys.isEmpty():
        return none, None
    # every text that holds any entity is a text with its words: common ones show here already
    beside = held.join(keys.select("key").distinct(), "key", "left_semi").select("key", F.explode("words").alias("term"))
    near_any = held.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("near_any"))
    measure = f"ln(((both + {weight} * p_e) / ({{}} + {weight})) / p_e) / {content}"
    # common words drop out within the join, before any pair of them is made
    pairs = keys.join(beside.join(near_any, "term"), "key") \
        .filter("near_any <= most").groupBy("entity", "term") \
        .agg(F.count(F.lit(1)).alias("both"), F.first("p_e").alias("p_e"), F.first("near_any").alias("near_any"),
             F.first("most").alias("most")) \
        .filter(F.expr(measure.format("near_any")) >= disclosure).select("entity", "term", "both", "p_e")
    pairs = written(pairs, "pii-pairs")
    if pairs.isEmpty():
        return none, None
    hits = written(_texts_with(rows, pairs.select("term").distinct()), "pii-hits")
    of_term = hits.groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    scored = pairs.join(of_term, "term").withColumn("disclosure", F.expr(measure.format("of_term"))) \
        .filter(F.expr(f"(both + {weight} * p_e) / (of_term + {weight}) >= {least} - 1e-12"))
    return cut_lineage(scored.select("term", "entity", F.col("both").alias("texts"), "disclosure")), hits


def _words_of(rows: DataFrame) -> DataFrame:
    """(key, term): every text's distinct words."""
    words = F.array_distinct(F.expr(f"regexp_extract_all(lower(text), {_quote(_WORD)}, 0)"))
    # both before the explode, or the text would be digested again for each of its words
    return rows.select(F.expr(_KEY.format("text")).alias("key"), words.alias("words")).select("key", F.explode("words").alias("term"))


def _small(df: DataFrame, most_bytes: int, *cols: str) -> bool:
    """The rows, with ``cols`` as text, take no more than so many bytes."""
    size = df.agg(F.sum(sum((F.octet_length(c) for c in cols), F.lit(32)))).collect()[0][0] or 0
    return size <= most_bytes


def _texts_with(rows: DataFrame, terms: DataFrame, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Distinct (key, term): which distinct texts hold which of the terms. The terms are
    broadcast only when their size shows they are few; beyond that the join shuffles, without
    the most frequent words that are no terms."""
    words = _words_of(rows)
    if _small(terms, broadcast_bytes, "term"):
        return words.join(F.broadcast(terms), "term", "left_semi").distinct()
    common = words.filter("octet_length(term) <= 256").groupBy("term").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "term").limit(20_000)
    common = cut_lineage(common.select("term").join(terms, "term", "left_anti"))
    rare = words.join(F.broadcast(common), "term", "left_anti")   # at most 20,000 words of 256 bytes
    return rare.join(terms, "term", "left_semi").distinct()


def _term_spans(text: str, terms: str) -> str:
    """SQL: places of the words of ``text`` that are among ``terms``."""
    return (f"case when size({terms}) > 0 then filter({_matches(text, _WORD)}, x -> array_contains({terms}, lower(x.m))) "
            f"else cast(array() as {_SPAN}) end")


def _with_terms(rows: DataFrame, text_col: str, broadcast_bytes: int = 8 << 20, whole_texts: bool = False,
                disclosure: float = 0.9, prior: float = 0.5, **how) -> DataFrame:
    """``rows`` plus ``__terms``: the disclosing terms of each text (an empty array mostly).
    No other column of ``rows`` may be named ``__key``."""
    texts = rows.select(F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    if whole_texts:
        terms, hits = _whole_text_terms(texts, disclosure, prior)
    else:
        terms, hits = disclosing_terms(rows, text_col, disclosure=disclosure, **how), None
    terms = terms.select("term").distinct()
    none = F.expr("cast(array() as array<string>)")
    if terms.isEmpty():
        return rows.withColumn("__terms", none)
    hits = _texts_with(texts, terms) if hits is None else hits.join(terms, "term", "left_semi")
    per_text = cut_lineage(hits.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_set("term")).alias("__terms")))
    if _small(per_text.select(F.array_join("__terms", " ").alias("all")), broadcast_bytes, "all"):
        per_text = F.broadcast(per_text)
    keyed = rows.withColumn("__key", F.expr(_KEY.format(f"`{text_col}`")))
    return keyed.join(per_text, "__key", "left").drop("__key").withColumn("__terms", F.coalesce("__terms", none))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    ``base_sha256`` is of the base spans, ``kind:start:end`` by kind and start, joined by
    commas; ``spans`` adds the method's ``term`` spans. Places are code points, ends
    exclusive. Null and empty texts have no spans; equal rows give equal rows; an
    empty table gives an empty result. Very long texts are searched whole; entities that
    share all their texts, as thousands in one text do, are weighed as one."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = base_spans(_with_terms(rows, "text", **how).withColumn("__term", F.expr(_term_spans("text", "__terms"))), "text")

    def listed(kinds):
        return "concat(" + ",".join(f"transform(coalesce(__{k}, cast(array() as {_SPAN})), "
                                    f"x -> concat('{k}:', x.s, ':', x.e))" for k in kinds) + ")"

    return found.select(
        F.col("id").alias(id_col),
        *[F.expr(f"cast(size(coalesce(__{k}, cast(array() as {_SPAN}))) as bigint)").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2(array_join({listed(KINDS)}, ','), 256)").alias("base_sha256"),
        F.expr(f"array_join({listed((*KINDS, 'term'))}, ',')").alias("spans"))


def _merged(spans: str) -> str:
    """SQL: (s, e, l, k) spans with those that overlap made one, under the kind of the longest,
    in the order of the text and in blocks, so that very many spans stay near linear."""
    span_t = "struct<s:int,e:int,l:int,k:string>"
    return (f"aggregate(array_sort({spans}), named_struct('done', cast(array() as array<array<{span_t}>>), "
            f"'b', cast(array() as array<{span_t}>), 'g', cast(null as {span_t})), "
            "(acc, x) -> case when acc.g is null then named_struct('done', acc.done, 'b', acc.b, 'g', x) "
            "when x.s < acc.g.e then named_struct('done', acc.done, 'b', acc.b, 'g', named_struct('s', acc.g.s, "
            "'e', greatest(acc.g.e, x.e), 'l', greatest(acc.g.l, x.l), 'k', case when x.l > acc.g.l then x.k else acc.g.k end)) "
            f"when size(acc.b) >= {_BLOCK} then named_struct('done', concat(acc.done, array(acc.b)), 'b', array(acc.g), 'g', x) "
            "else named_struct('done', acc.done, 'b', concat(acc.b, array(acc.g)), 'g', x) end, "
            "acc -> concat(acc.done, array(concat(acc.b, array(acc.g)))))")


def _replaced(text: str, blocks: str) -> str:
    """SQL: ``text`` with each span of the blocks replaced by the name of its kind."""
    part = (f"named_struct('b', b, 'at', b[0].s, 'end', coalesce(get({blocks}, i + 1)[0].s, length({text})))")
    cut = f"named_struct('b', p.b, 'at', p.at, 'end', p.end, 't', substring({text}, p.at + 1, p.end - p.at))"
    named = ("array_join(transform(c.b, (x, j) -> concat('[', upper(x.k), ']', "
             "substring(c.t, x.e - c.at + 1, coalesce(get(c.b, j + 1).s, c.end) - x.e))), '')")
    return (f"concat(substring({text}, 1, {blocks}[0][0].s), array_join(transform(transform(transform({blocks}, "
            f"(b, i) -> {part}), p -> {cut}), c -> {named}), ''))")


def sanitise(df: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``df`` with personal data replaced by the name of its kind and disclosing terms
    generalised to ``[TERM]``; all other columns and clean texts stay as they are. All spans
    are found in the text as it was, overlapping ones are replaced as one."""
    # the columns of ``df`` may have any names: they get numbers, which none of our own is
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    own = f"c{df.columns.index(text_col)}"
    held = _with_terms(plain, own, **how).withColumn("__text", F.col(own).cast("string"))
    found = base_spans(held.withColumn("__term", F.expr(_term_spans("__text", "__terms"))), "__text")
    spans = "concat(" + ",".join(
        f"transform(coalesce(__{k}, cast(array() as {_SPAN})), x -> named_struct('s', x.s, 'e', x.e, 'l', x.e - x.s, 'k', '{k}'))"
        for k in (*KINDS, "term")) + ")"
    out = found.withColumn("__spans", F.expr(spans)) \
        .withColumn("__blocks", F.expr(f"case when size(__spans) > 0 then {_merged('__spans')} end"))
    text = F.expr(f"case when __blocks is null then {own} else {_replaced('__text', '__blocks')} end")
    return out.withColumn(own, text).select(*plain.columns).toDF(*df.columns)
