"""N-gram join, phrase mining and ranked search against brute force and their SQL twins."""

import math
import pathlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard

from sparkeda.llm import ngram_join, phrases, queries, search

from sparkeda.session import checkpoint_dir

from .helpers import DOCS, clashing, edge_documents, rows_of, words


@pytest.mark.parametrize("name", ["op11_ngram_join", "op12_collocations", "op13_ranked_search"])
def test_queries_equal_their_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert want and rows_of(got, *cols) == sorted(want, key=repr)


# -- op 11 ---------------------------------------------------------------------------------
def _shingles(text, size=5):
    w = words(text)
    return {" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_join(rows, percent=80):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)] += [k] if k is not None else []
    return sorted(((k, len(s), (min(least[find(i)], default=None)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))),
                  key=repr)


def _family(r, n_words, copies, edits):
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(n_words)]
    out = [base]
    for _ in range(copies):
        w = list(r.choice(out))
        for _ in range(edits):
            w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_sets_share_a_signature(percent):
    """Pairs at and just above the threshold, of all sizes, within and across bands."""
    r = np.random.default_rng(5)
    bands = ngram_join._Bands(percent)
    checked = 0
    for n in [*range(1, 60), 100, 333, 1000, 3000]:
        for _ in range(12):
            m = int(r.integers(n, max(n, n * 100 // percent) + 1))
            need = -(-percent * (n + m) // (100 + percent))       # least intersection
            if need > n or 100 * need < percent * (n + m - need):
                continue
            pool = np.unique(r.integers(1, 2 ** 63, n + m + 5).astype(np.uint64))
            r.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:need], pool[n:n + m - need]]))
            seen = [set(), set()]
            sure = [defaultdict(lambda: defaultdict(int)) for _ in range(2)]
            for which, band, level, agreeing, sig in ngram_join.signatures([a, b], bands):
                for w, bd, s, g in zip(which, band, sig, agreeing):
                    seen[w].add(int(s))
                    sure[w][(int(bd), level)] = int(g)
            shared = seen[0] & seen[1]
            assert shared, (n, m, need)
            top = [max(l for b_, l in s) for s in sure]
            assert min(top) >= 0
            checked += 1
    assert checked > 300


def test_agreeing_counts_are_lower_bounds():
    r = np.random.default_rng(6)
    bands = ngram_join._Bands(80)
    for n in (20, 60, 200, 900):
        pool = np.unique(r.integers(1, 2 ** 63, 2 * n).astype(np.uint64))
        r.shuffle(pool)
        gone = 2 * n * 20 // 180 // 2
        a, b = np.sort(pool[:n]), np.sort(pool[gone:n + gone])
        by = [defaultdict(set), defaultdict(set)]
        claim = [{}, {}]
        for which, band, level, agreeing, sig in ngram_join.signatures([a, b], bands):
            for w, bd, s, g in zip(which, band, sig, agreeing):
                by[w][(int(bd), level)].add(int(s))
                claim[w][(int(bd), level)] = int(g)
        for key in set(by[0]) & set(by[1]):
            assert len(by[0][key] & by[1][key]) >= max(claim[0][key], claim[1][key])


def test_join_equals_brute_force(spark):
    r = random.Random(4)
    texts = []
    for n_words, copies, edits in ((5, 4, 1), (9, 6, 1), (14, 8, 1), (40, 12, 1), (60, 12, 2), (200, 10, 4), (900, 6, 12)):
        for _ in range(4):
            texts += _family(r, n_words, copies, edits)
    passage = " ".join(f"p{i}" for i in range(60))                # many share it, few are similar
    texts += [passage + " " + " ".join(f"q{r.randrange(10 ** 6)}" for _ in range(r.choice((20, 100)))) for _ in range(150)]
    texts += [texts[0]] * 5 + [texts[40].upper()] * 3 + ["", None, " \n", "one", "one two", "ONE two", "one two three four"]
    r.shuffle(texts)
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.similar_documents(df)
    want = brute_join(rows)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert len({w[2] for w in want}) < len(want) - 80


def test_members_of_large_groups_that_meet_elsewhere_leave(spark):
    """One passage in over 64 documents, pairs of which are near copies."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = []
    for i in range(120):
        own = [f"x{r.randrange(10 ** 7)}" for _ in range(120)]
        rows.append((2 * i, passage + " " + " ".join(own)))
        own[r.randrange(120)] = "changed"
        rows.append((2 * i + 1, passage + " " + " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(ngram_join.similar_documents(df), "doc_id", "n_shingles", "component_id") == brute_join(rows)


def test_pairs_that_share_many_groups_are_given_out_once(spark):
    """Five classes that share 40 groups and two that share 200 of their 300."""
    rows = [(g, c, c, 10, [0] * 16) for g in range(40) for c in range(5)]
    rows += [(g, c, c, 10, [0] * 16) for c, own in ((10, range(1000, 1300)), (11, range(1100, 1400))) for g in own]
    members = spark.createDataFrame(rows, "g long, c long, root long, n long, sketch array<long>")
    got = [tuple(x) for x in ngram_join._pairs_once(members, 80).collect()]
    small = [x for x in got if x[0] < 5]
    assert sorted(small) == [(a, b) for a in range(5) for b in range(a + 1, 5)]
    assert (10, 11) in got


def test_join_edges(spark):
    df = edge_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = ngram_join.similar_documents(clashing(df).drop("component_id"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_join(rows)
    assert ngram_join.similar_documents(df.limit(0)).count() == 0
    empty = ngram_join.similar_documents(df.filter("doc_id in (0, 1)"))
    assert rows_of(empty, "doc_id", "n_shingles", "component_id") == [(0, 0, 0), (1, 0, 1)]


def test_long_text_is_cut_between_words(monkeypatch):
    text = " ".join(f"word{i % 900}é" for i in range(5000))
    whole = ngram_join.shingle_set(text)
    monkeypatch.setattr(ngram_join, "_CHUNK", 1000)
    assert (ngram_join.shingle_set(text) == whole).all() and len(whole) == 900


def test_packed_sets_come_back():
    for n in (1, 2, 500, 20_000):
        s = np.unique(np.random.default_rng(n).integers(0, 2 ** 64, n, dtype=np.uint64))
        assert (ngram_join._unpack_set(ngram_join._pack_set(s)) == s >> np.uint64(16)).all()


# -- op 12 ---------------------------------------------------------------------------------
def _pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_counts(rows, most=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    return f, n


def brute_collocations(rows, min_count, most=5, top=2000):
    counts, n = brute_counts(rows, most)
    out = []
    for lang, all_f in counts.items():
        f = {p: c for p, c in all_f.items() if c >= min_count}
        inside = defaultdict(int)
        for p, c in f.items():
            for m in range(1, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], c)
        got = []
        for p, a in f.items():
            if len(p) < 2 or inside[p] >= a:
                continue
            s, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            got.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(got)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out, key=repr)


COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _chatter(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "New", "york\tCity", "…", "don't"]
    return [(r.choice(["en", "de", None]), "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"])
                                                   for _ in range(r.randint(0, 120)))) for _ in range(n)]


def test_collocations_equal_brute_force(spark):
    rows = _chatter(120) + [("en", "a a a a a a a a"), ("en", None), (None, ""), ("fr", "only once here")]
    rows += [("en", "the quick brown fox jumps. The quick brown fox sleeps")] * 12
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    want = brute_collocations(rows, 5)
    assert len(want) > 40
    assert rows_of(phrases.collocations(df.repartition(3), min_count=5), *COLS) == want
    few = brute_collocations(rows, 5, top=7)
    assert rows_of(phrases.collocations(df, min_count=5, top=7), *COLS) == few
    clash = clashing(df).withColumnRenamed("rank", "phrase").withColumnRenamed("terms", "f").withColumnRenamed("node", "words")
    assert rows_of(phrases.collocations(clash, min_count=5), *COLS) == want


def test_phrase_levels_in_small_blocks_and_slices(monkeypatch):
    """Blocks cut inside texts, several buckets, hot prefixes cut into slices."""
    monkeypatch.setattr(phrases, "_BLOCK_TOKENS", 40)
    monkeypatch.setattr(phrases, "_SLICE", 15)
    monkeypatch.setattr(phrases, "_CHUNK", 30)
    rows = _chatter(60, seed=2)
    batch = pa.RecordBatch.from_pydict({"lang": [x or "und" for x, _ in rows], "text": [t for _, t in rows]})
    states = list(phrases._number_words([batch]))
    assert len(states) > 20
    counts, n = brute_counts(rows)
    total = Counter()
    for s in states:
        for f in s.column("found")[0].as_py():
            total[f["lang"]] += f["f"]
    assert total == +n
    for level in range(1, 5):
        given = list(phrases._give_stripes(level, 3)(states))
        if not given:
            assert not any(c >= 4 for x in counts.values() for p, c in x.items() if len(p) == level)
            break
        by = defaultdict(list)
        for g in given:
            by[g.column("bucket")[0].as_py()].append(g)
        answers = pa.concat_tables([phrases._merge(4, 3)(pa.Table.from_batches(b)) for b in by.values()])
        found, after = {}, []
        for s in states:
            mine = answers.filter(pa.compute.equal(answers.column("block"), s.column("block")[0]))
            new = phrases._go_on(level, 3, False)(pa.Table.from_batches([s]), mine)
            for f in new.column("found")[0].as_py():
                assert (f["lang"], f["phrase"]) not in found
                found[f["lang"], f["phrase"]] = f["f"]
            after += new.to_batches()
        states = after
        assert found == {(lang, " ".join(p)): c for lang, x in counts.items() for p, c in x.items() if len(p) == level and c >= 4}


def test_blocks_of_past_levels_are_deleted(spark):
    """Only the last level's blocks, which are empty, stay beside the phrases found."""
    folder = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    there = set(folder.iterdir())
    rows = _chatter(60, seed=3)
    df = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(rows)], "doc_id long, lang string, text string")
    known = phrases.frequent_phrases(df, min_count=5)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - there}
    assert left == {"phrases-5", *(f"phrases-told-{i}" for i in range(6))}
    counts, _ = brute_counts(rows)
    want = {(x, " ".join(p), c) for x, own in counts.items() for p, c in own.items() if c >= 5}
    assert {(r.lang, r.phrase, r.f) for r in known.filter("words > 0").collect()} == want


def test_packed_numbers_come_back_and_are_small():
    rng = np.random.default_rng(5)
    arrays = [np.zeros(0, np.uint64), np.array([0, 2 ** 64 - 1, 255, 256], np.uint64), rng.integers(0, 2 ** 40, 1000), np.array([True, False])]
    for x, got in zip(arrays, phrases._unpack(phrases._pack(*arrays)), strict=True):
        assert (x.astype(np.uint64) == got).all() and len(x) == len(got)
    for seq in (np.zeros(0, "<i4"), np.array([0, 127, 128, 2 ** 31 - 1], "<i4")):
        assert phrases._unpack_places(phrases._pack_places(seq)).tolist() == seq.tolist()
    words = [f"w{int(x)}" for x in rng.permutation(5000)[np.minimum(rng.zipf(1.2, 60_000), 5000) - 1]]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [" ".join(words)]})
    state, = phrases._number_words([batch])
    own = phrases._State.read(state, 0)
    assert [own.text[i - 1].decode() for i in own.seq[:-1]] == words
    numbers = {}
    first_seen = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], "<i4")
    assert len(state.column("seq")[0].as_py()) < 0.85 * len(zstandard.ZstdCompressor(level=3).compress(first_seen.tobytes()))


def test_collocation_edges(spark):
    df = edge_documents(spark)
    rows = [(r["lang"], r["text"]) for r in df.collect()]
    assert rows_of(phrases.collocations(df, min_count=2), *COLS) == brute_collocations(rows, 2)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.filter("doc_id < 3")).count() == 0


def test_scores_beyond_64_bits(spark):
    """Large counts: the products are exact decimals."""
    rows = spark.sql("select cast(9000000000000 as long) a, cast(90000000000000 as long) n, 9000000000001L l, 9000000000003L r")
    got = rows.selectExpr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) s")
    a, n, l, r = 9 * 10 ** 12, 9 * 10 ** 13, 9 * 10 ** 12 + 1, 9 * 10 ** 12 + 3
    assert got.collect()[0]["s"] == 1000 * a * n // (l * r)


# -- op 13 ---------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    bags = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        asked = set(TERM.findall(low(text)))
        got = []
        for i, b, n in bags:
            m = 10 + 90 * n * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in asked if t in b)
            if s > 0:
                got.append((-s, i is None, i if i is not None else 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = "item_id long, text string"


def test_search_equals_brute_force(spark):
    r = random.Random(8)
    weights = [1 / (i + 1) for i in range(400)]
    draw = lambda n: " ".join(f"t{i}" for i in r.choices(range(400), weights, k=n))
    items = [(i, draw(12)) for i in range(30)] + [(40, "T1 t399, t398"), (41, "unknown"), (42, ""), (43, None), (40, "T1 t399, t398"),
                                                  (0, "other text, same id t5")]
    docs = [(i, draw(r.choice((3, 20, 200)))) for i in range(900)]
    docs += [(1000 + i, items[3][1] + " " + draw(5)) for i in range(15)] + [(2000 + i, items[4][1]) for i in range(30)]
    docs += [(3000, None), (3001, "..."), (None, items[4][1]), (7, items[4][1]), (7, items[4][1])]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = search.ranked_search(df, spark.createDataFrame(items, ITEMS))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, items)
    three = search.ranked_search(df, spark.createDataFrame(items, ITEMS), k=3)
    assert rows_of(three, "item_id", "rank", "doc_id", "score") == brute_search(docs, items, 3)


def test_search_shards_skip_only_what_cannot_win(monkeypatch):
    """Small blocks and given floors: the same best documents, fewer scored."""
    r = np.random.default_rng(2)
    n, v, k = 600, 80, 5
    dense = r.integers(0, 900_000, (n, v)) * (r.random((n, v)) < 0.15)
    weight = r.integers(1, 9000, v)
    items = [r.choice(v, 10, replace=False) for _ in range(6)]
    row, term = np.nonzero(dense)
    want = []
    for t in items:
        s = dense[:, t] @ weight[t]
        want.append([(int(-s[i]), False, int(i)) for i in sorted(range(n), key=lambda i: (-s[i], i))[:k]])
    monkeypatch.setattr(search, "_BLOCK", 8)
    for floors in (np.zeros(6, np.int64), np.array([-w[-1][0] for w in want])):
        best = search._Best(floors, k)
        search._search_shard(row, term, dense[row, term], list(range(n)), items, 0, weight, dense.max(axis=0), best)
        assert best.rows == want


def test_search_edges(spark):
    df = edge_documents(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = [(1, "Lorem IPSUM one"), (2, "中文 a"), (None, "b c"), (3, "12 é")]
    asked = spark.createDataFrame(items, ITEMS)
    got = search.ranked_search(clashing(df), clashing(asked))
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(docs, items)
    assert search.ranked_search(df.limit(0), asked).count() == 0
    assert search.ranked_search(df, asked.limit(0)).count() == 0
    assert search.ranked_search(df.filter("doc_id < 3"), asked).count() == 0
    assert spark.createDataFrame([], DOCS).count() == 0
