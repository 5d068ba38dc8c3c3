"""BPE, packing, SimHash, personal data and language ID against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkeda.llm import bpe, langid, packing, pii, queries, simhash

from .helpers import (brute_base, brute_components, brute_fingerprint, clashing, edge_documents, random_texts,
                      rows_of)

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- op 4 ----------------------------------------------------------------------------------
def test_bpe_equals_the_library(library):
    chars = [chr(i) for i in range(0x3000)] + [chr(i) for i in range(0x1F300, 0x1F700)]
    texts = ["a" + c + "1" + c + c + " " + c + "x" + c for c in chars] + random_texts(500) + [
        "it's we're'll they'd 'sx 't", "a  b\n\n c \n", "x<|endoftext|> y <|endoftext|>", "é" * 900, "ab" * 3000, ""]
    own = bpe.ByteBpe.load(PATH)
    got = own.encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(g) for g in got] == texts


def test_bpe_segments_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    text = "Some words, it's 12  spaces \n\n and more " * 40
    assert bpe.ByteBpe.load(PATH).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_forgets_words_without_changing_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    own, texts = bpe.ByteBpe.load(PATH), random_texts(50)
    for t in texts:
        assert own.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_query(spark, sf, docs, library):
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = queries.QUERIES["op4_bpe"](spark, sf)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_edges(spark, library):
    df = edge_documents(spark)
    got = bpe.bpe_documents(clashing(df), PATH, with_ids=True)
    want = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "")
            for r in df.collect()]
    assert rows_of(got, "doc_id", "ids", "decoded") == sorted(want, key=repr)
    assert bpe.bpe_documents(df.limit(0), PATH).count() == 0


# -- op 1 ----------------------------------------------------------------------------------
def _check_packing(rows, texts, library, capacity):
    want = defaultdict(list)
    for i, t in texts:
        want[(i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()))] = 1
    by_seq, per_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_seq, per_doc


def test_packing_query(spark, sf, docs, library):
    rows = queries.QUERIES["op1_best_fit_packing"](spark, sf).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    by_seq, per_doc = _check_packing(rows, texts, library, 2048)
    total = 0
    for i, t in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(per_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        at = 0
        for p in parts:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids) and all(p["length"] == 2048 for p in parts[1:])
        total += len(ids)
    assert len(by_seq) <= -(-total // 2048) * 1.03 + 1


def test_packing_edges(spark, library):
    df = edge_documents(spark)
    rows = packing.pack_documents(clashing(df), PATH, capacity=64).collect()
    texts = [r["text"] or "" for r in df.collect()]
    by_seq, _ = _check_packing(rows, [], library, 64)
    assert sum(r["length"] for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("lengths", [{1: 5000}, {1024: 7}, {700: 300, 1300: 299}, {2048: 3, 1: 1}, {1025: 9, 1023: 4, 3: 50}])
def test_packing_rounds_place_everything_once(lengths):
    rounds, n = packing.plan_rounds(lengths, 2048)
    got = [np.stack(a, 1) for a in packing._walk(np.arange(n), rounds, 2048)]
    got = np.concatenate(got)
    assert len(got) == sum(lengths.values())
    assert len({(a, b) for a, b, _, _ in got.tolist()}) == len(got)
    assert n <= max(-(-sum(k * v for k, v in lengths.items()) // 2048) * 1.5 + 1, sum(v for k, v in lengths.items() if k > 1024))


# -- op 10 ---------------------------------------------------------------------------------
def test_simhash_query(spark, sf, docs):
    rows = docs.collect()
    fp = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    root = brute_components(fp.values())
    least = {}
    for i, f in fp.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least[root[f]]) for i, f in fp.items()]
    got = queries.QUERIES["op10_simhash"](spark, sf)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_simhash_edges(spark):
    df = edge_documents(spark)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(clashing(df)).collect()}
    rows = df.collect()
    assert set(got) == {(r["doc_id"], f"{brute_fingerprint(r['text']):016x}") for r in rows}
    assert got[(0, "0" * 16)] == got[(2, "0" * 16)] == 0
    assert simhash.simhash_components(df).count() == len(rows)
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_simhash_links_planted_distances(spark):
    """Random fingerprints with partners at 1, 2, 3 and 4 bits, in one half and across."""
    r = np.random.default_rng(1)
    fps = []
    for k in range(240):
        f = int(r.integers(0, 2 ** 63)) * 2 + k % 2
        fps.append(f)
        g = f
        span = [(0, 64), (0, 32), (32, 64)][k % 3]
        for b in r.choice(np.arange(*span), k % 4 + 1, replace=False):
            g ^= 1 << int(b)
        fps.append(g)
    signed = [f - 2 ** 64 if f >= 2 ** 63 else f for f in sorted(set(fps))]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from sparkeda.llm.components import connected_components
    comp = {x["node"]: x["root"] for x in connected_components(simhash.links(df)).collect()}
    want = brute_components(fps)
    got = {f: comp.get(s, s) for f, s in zip(sorted(set(fps)), signed)}
    classes = lambda m: sorted(sorted(x for x in m if m[x] == v) for v in set(m.values()))
    assert classes(got) == classes(want)


def test_components_of_a_chain_and_a_star(spark):
    from sparkeda.llm.components import connected_components
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 50)}


# -- op 7 ----------------------------------------------------------------------------------
def _base_of(spans):
    return [x for x in spans.split(",") if x and not x.startswith("term:")]


def test_personal_data_equals_definitions(spark, docs):
    texts = random_texts(400) + [r["text"] for r in docs.collect()] + [
        "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.4111 1111 1111 1111", "001.002.003.004 and 256.1.1.1",
        "+1 (2", "+123456789012345678", "4111 1111 1111 1111-", "a" * 20000 + "@", "9" * 20000, "1-" * 5000,
        "x@y.z " * 500, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        want = brute_base(texts[r["doc_id"]])
        assert _base_of(r["spans"]) == want, texts[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        for k in pii.KINDS:
            assert r[f"n_{k}"] == sum(x.startswith(k) for x in want)


def test_personal_data_terms(spark):
    """A nickname that stands beside one address in many texts discloses it; a common word
    beside it does not; exact copies add no evidence."""
    rows = [(i, f"text {i} please write zorblat at z@private.org number {i}") for i in range(6)]
    rows += [(10 + i, f"please write number {i} to someone else") for i in range(40)]
    rows += [(60 + i, "copied words beside k@copies.net are quarmix") for i in range(9)]
    rows += [(80, "the name Zorblat alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # 6 of its 7 texts, 6 of 48 texts in all: log(48 / 7) / log(48 / 6) = 0.926
    assert not pii.disclosing_terms(df, disclosure=0.95).collect()
    assert {r["term"] for r in pii.disclosing_terms(df).collect()} == {"zorblat"}
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df).collect()}
    assert spans[80] == "term:9:16" and spans[12] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[80] == "the name [TERM] alone" and clean[12] == rows[8][1]
    assert clean[0] == "text 0 please write [TERM] at [EMAIL] number 0"


def brute_terms(texts, d=0.9, prior=0.5):
    """{(term, entity): (texts, disclosure)} over whole distinct texts, from the definition; of
    entities with the same texts the smallest stands for all."""
    word = lambda t: set(re.findall(r"[^\W\d_]+", t.lower()))
    of_term, of_entity, both = Counter(), defaultdict(set), defaultdict(set)
    texts = {t for t in texts if t is not None}
    for t in texts:
        of_term.update(word(t))
        spans = [tuple(map(int, x.split(":")[1:])) for x in brute_base(t)]
        gone = {at for s in spans for at in range(*s)}
        for e in {t[a:b].lower() for a, b in spans}:
            of_entity[e].add(t)
            for w in word("".join("1" if at in gone else c for at, c in enumerate(t))):
                both[w, e].add(t)
    first = {}
    for e in sorted(of_entity):
        first.setdefault(frozenset(of_entity[e]), e)
    out = {}
    for (w, e), k in both.items():
        p = len(of_entity[e]) / len(texts)
        if p == 1 or first[frozenset(of_entity[e])] != e:
            continue
        weight = prior * -math.log(p)
        drawn = (len(k) + weight * p) / (of_term[w] + weight)
        if drawn >= max(0.5, p ** (1 - d)) - 1e-12:
            out[w, e] = (len(k), pytest.approx(math.log(drawn / p) / -math.log(p)))
    return out


def test_personal_data_terms_of_whole_texts(spark, docs):
    """Far words and short names are judged like all others; one or two texts prove nothing."""
    far = "filler words " * 40
    texts = [f"Bob {far} lives at 10.0.0.7"] + [f"Li {far} writes to q@w.org number {'x' * i}" for i in range(6)]
    texts += [f"filler words writes to number lives at {'x' * i}" for i in range(90)] + texts[:1] + [None, "so bob ran"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["term"], r["entity"]): (r["texts"], r["disclosure"]) for r in pii.disclosing_terms(df, whole_texts=True).collect()}
    assert got == brute_terms(texts) and set(got) == {("li", "q@w.org")}
    some = [r["text"] for r in docs.collect()]
    some += [f"{t} ask qzor for 10.9.8.7 or +44 20 7946 0958" for t in some[:9] if t]
    want = brute_terms(some)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    terms = pii.disclosing_terms(df, whole_texts=True)
    assert {(r["term"], r["entity"]): (r["texts"], r["disclosure"]) for r in terms.collect()} == want
    assert ("qzor", "+44 20 7946 0958") in want and not any(e == "10.9.8.7" for _, e in want)
    rows, few = df.select("text"), terms.select("term").distinct()
    assert rows_of(pii._texts_with(rows, few, 0), "key", "term") == rows_of(pii._texts_with(rows, few), "key", "term")


def test_needed_support_does_not_shrink_with_the_corpus():
    """The texts a word must share with an entity, at least, over growing corpora."""
    need = []
    for n in (10 ** 3, 10 ** 4, 10 ** 6, 10 ** 9, 10 ** 12):
        for k in range(1, 50):
            p, weight = k / n, -0.5 * math.log(k / n)
            if (k + weight * p) / (k + weight) >= max(0.5, p ** 0.1):
                need.append(k)
                break
    assert need == sorted(need) and need[0] >= 3


def test_a_text_of_very_many_entities(spark):
    """20,000 addresses in the same five texts are weighed as one entity."""
    many = " ".join(f"u{i}@h.org" for i in range(20_000))
    rows = [(i, f"{many} kept by zorblat {'y' * (i + 1)}") for i in range(5)] + [(10 + i, f"plain text kept by {'z' * i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["term"], r["entity"], r["texts"]) for r in pii.disclosing_terms(df, whole_texts=True).collect()]
    assert got == [("zorblat", "u0@h.org", 5)]


def test_sanitise_keeps_clashing_columns_with_terms(spark):
    """Terms are present, and columns are named like the operator's own."""
    rows = [(i, f"zorblat {'w' * (i + 1)} z@private.org") for i in range(8)] + [(20 + i, f"other words {'v' * i}") for i in range(200)] \
        + [(99, "the zorblat spoke")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "__terms", "__key", "__text", "__spans", "__blocks", "__email", "term", "entities", "words", "c0", "c1", "n"):
        df = df.withColumn(name, F.lit(name))
    out = pii.sanitise(df, whole_texts=True)
    assert out.columns == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] == "[TERM] w [EMAIL]" and got[20]["text"] == rows[8][1]
    assert got[99]["text"].startswith("the [") and got[99]["key"] == "key" and got[99]["__terms"] == "__terms"


def test_personal_data_edges(spark):
    df = edge_documents(spark)
    got = pii.find_personal_data(clashing(df))
    want = [(r["doc_id"], ",".join(brute_base(r["text"]))) for r in df.collect()]
    assert rows_of(got, "doc_id", "spans") == sorted(want, key=repr)
    assert pii.find_personal_data(df.limit(0)).count() == 0
    assert pii.sanitise(clashing(df)).columns == clashing(df).columns


def test_sanitise_leaves_nothing_of_a_span(spark):
    """Every character of a span found in the text goes, also where kinds overlap."""
    texts = ["call +33.1.42.68.53.00 now", "+1.2.3.4", "a@1.2.3.4 x", "+4111 1111 1111 1111", "x@y.z 10.0.0.1 " * 200,
             "é😀 +44.20.7946.0958é x@y.zz", "clean", "", None] + random_texts(300, seed=8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == "call [PHONE] now" and clean[7] == "" and clean[8] is None
    for i, t in enumerate(texts):
        gone = {at for x in brute_base(t) for at in range(*map(int, x.split(":")[1:]))}
        kept = "".join(c for at, c in enumerate(t or "") if at not in gone)
        assert re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", clean[i] or "") == kept, t


# -- op 8 ----------------------------------------------------------------------------------
def test_language_id_on_held_out_documents(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_language_id"](spark, sf).collect()}
    held = [(r["lang"], got[r["doc_id"]]) for r in docs.collect()
            if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(g["held_out"] for _, g in held) and sum(g["held_out"] for g in got.values()) == len(held)
    assert sum(lang == g["lang_pred"] for lang, g in held) / len(held) > 0.95
    assert all(0 <= g["score"] <= 1 for g in got.values())
    assert sum(g["rejected"] for g in got.values()) / len(got) < 0.02


def test_language_id_edges(spark, docs):
    model = langid.train_models(docs.select(docs.doc_id.alias("id"), "text", "lang"))
    df = edge_documents(spark)
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.identify(clashing(df), model).collect()}
    assert {(0, "und", True), (1, "und", True), (2, "und", True)} <= got
    assert (13, "und", True) not in got
    assert langid.identify(df.limit(0), model).count() == 0
    empty = langid.identify_with_labels(clashing(df.filter("lang is null")))
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    """Over the alphabet plus the unseen share, the probabilities after a context add up."""
    texts = [langid.normalise(t) for t in ("abracadabra cab", "bad cab dab", "abba")]
    m = langid.fit("x", texts)
    alphabet = sorted(set(np.concatenate(texts).tolist()))
    for context in ("ab", "ra", "b", "zz"):
        total = 0.0
        for c in alphabet:
            h = langid._hashes(np.array([*map(ord, context), c], dtype=np.uint32))
            before = [np.array([x[-2]]) for x in h]
            total += float(np.exp(langid.log_probabilities(m, [x[-1:] for x in h], before, np.array([len(context) + 1])))[0])
        assert 0.5 < total < 1.05
