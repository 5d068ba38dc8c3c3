"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


#: Exact integer arithmetic, so DuckDB can say the same: floor(1024 x) inner products.
ORACLE["op6_top_k"] = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10"""


ORACLE["op3_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE["op11_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT row, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT row, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row, count(*)::BIGINT AS n FROM sh GROUP BY row),
shared AS (SELECT a.row AS a, b.row AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.row < b.row GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.row = a JOIN n y ON y.row = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT row, row FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d ON d.row = reach.a JOIN d o ON o.row = reach.b LEFT JOIN n ON n.row = d.row
GROUP BY d.row, d.doc_id"""

ORACLE["op12_collocations"] = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 6) t(m) WHERE len(ws) >= m)),
n AS (SELECT lang, count(*)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, phrase, m, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT lang, f, m, string_split(phrase, ' ') AS ws, phrase FROM f),
longer AS (SELECT lang, sub, max(f) AS f FROM (
             SELECT lang, f, unnest([array_to_string(ws[s:s + k - 1], ' ') for s in range(1, m - k + 2)]) AS sub
             FROM (SELECT *, unnest(range(2, m)) AS k FROM x WHERE m > 2)) GROUP BY ALL),
c AS (SELECT x.* FROM x LEFT JOIN longer y ON x.lang = y.lang AND x.phrase = y.sub
      WHERE x.m > 1 AND (y.f IS NULL OR 100 * y.f < 100 * x.f)),
cut AS (SELECT lang, phrase, f AS a, k, array_to_string(ws[:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
        FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, k, l.f AS l, r.f AS r, n,
        ((1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = first JOIN f r ON r.lang = cut.lang AND r.phrase = rest
      JOIN n ON n.lang = cut.lang),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM one QUALIFY rank <= 2000"""

ORACLE["op13_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
             regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
           FROM documents),
s AS (SELECT row, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS alls FROM s),
i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
t AS (SELECT row, doc_id, n, unnest(ts) AS term FROM s),
p AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term),
scored AS (
  SELECT item_id, text, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // alls))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_best_fit_packing(spark, sf_dir):
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op2_nearest_neighbours(spark, sf_dir):
    from .ann import nearest
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))


@query
def op3_warc(spark, sf_dir):
    from .warc import archive_round_trip
    return archive_round_trip(table(spark, sf_dir, "pages")) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_bpe(spark, sf_dir):
    from .bpe import bpe_documents
    return bpe_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_lm_scoring(spark, sf_dir):
    from .lm import score_texts
    return score_texts(table(spark, sf_dir, "documents"))


@query
def op6_top_k(spark, sf_dir):
    from .topk import top_k
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


@query
def op7_personal_data(spark, sf_dir):
    from .pii import find_personal_data
    return find_personal_data(table(spark, sf_dir, "documents"), whole_texts=True)


@query
def op8_language_id(spark, sf_dir):
    from .langid import identify_with_labels
    return identify_with_labels(table(spark, sf_dir, "documents"))


@query
def op9_url_filters(spark, sf_dir):
    from .urls import filter_urls
    return filter_urls(table(spark, sf_dir, "pages"))


@query
def op10_simhash(spark, sf_dir):
    from .simhash import simhash_components
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op11_ngram_join(spark, sf_dir):
    from .ngram_join import similar_documents
    return similar_documents(table(spark, sf_dir, "documents"))


@query
def op12_collocations(spark, sf_dir):
    from .phrases import collocations
    return collocations(table(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark, sf_dir):
    from .search import ranked_search
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def pipeline(spark, sf_dir):
    from corpus_pipeline import run
    return run(spark, sf_dir)
