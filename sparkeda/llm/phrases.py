"""Phrase collocation mining (operator 12) with stripes.

A stripe belongs to a prefix and counts the words that follow it. Texts are numbered once
and kept in blocks of bounded size; level by level every block gives out, for each of its
prefixes that is frequent, the stripe of next words. Stripes of a prefix are merged
elementwise; the merged counters give the extensions of the prefix (its frequent phrases of
one more word), whose totals are the prefixes of the next level, and, as no phrase is more
frequent than a phrase inside it, the largest counter over a phrase and its one-word extensions on
either side decides whether it is subsumed.

A phrase can only be frequent if its first and its last words but one are, so a block goes
on only with places where both were found frequent. The blocks learn that from the merged
stripes by an equi-join on block number; no list of words or phrases is ever broadcast
or held in one place. Stripes are dealt by prefix; that of a frequent prefix is cut into
slices of next words, one for about a million occurrences of the prefix, so that a hot
prefix is merged by many tasks. Words and phrases are told apart by 64 bits of a hash
within a bucket dealt by another 64.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import texts_in_slices
from .tables import remove, written

_BLOCK_TOKENS = 2_000_000
_BUCKET_TOKENS = 4_000_000   # occurrences, thus stripe entries at most, for one bucket of a level
_SLICE = 1 << 20             # occurrences of a prefix for one slice of its stripe
_CHUNK = 4_000_000           # bytes of a text split at once
_PIECE_END = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case; everything that ends a piece becomes ".", which no word can hold
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in _PIECE_END else b for b in range(256))
_PACKED = ("seq", "id", "f", "last", "lang", "text")
_STATE = "block string, " + ", ".join(f"{c} binary" for c in _PACKED) + \
         ", langs array<string>, found array<struct<lang: string, phrase: string, f: bigint>>"
_STATE_ARROW = pa.schema([
    ("block", pa.string()), *((c, pa.binary()) for c in _PACKED), ("langs", pa.list_(pa.string())),
    ("found", pa.list_(pa.struct([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])))])


def _tokens(text: str | None):
    """Token lists of a text; b"." ends a piece. Long texts come in parts cut between pieces."""
    data = (text or "").encode().translate(_BYTES)
    at = 0
    while at < len(data):
        end = data.find(b".", at + _CHUNK)
        end = len(data) if end < 0 else end + 1
        yield data[at:end].replace(b".", b" . ").split()
        at = end


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(data)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0, one after another, compressed: the lowest byte of all numbers of
    an array, then the next byte, as far as the largest number has bytes."""
    sizes, parts = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x, "<u8")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        sizes += [len(x), width]
        parts.append(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return _squeeze(np.array(sizes, "<u8").tobytes() + b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<u8", 1)[0])
    out, at = [], 8 * (1 + 2 * n)
    for size, width in np.frombuffer(data, "<u8", 2 * n, 8).reshape(n, 2).tolist():
        x = np.zeros((size, 8), np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
        out.append(x.view("<u8").reshape(size))
        at += size * width
    return out


def _pack_places(seq: np.ndarray) -> bytes:
    """Numbers of which most are small: 7 bits of each and a mark where more follow, then the rest."""
    rest = seq >> 7
    return _pack(seq & 127 | (rest > 0) << 7, rest[rest > 0])


def _unpack_places(blob: bytes) -> np.ndarray:
    low, rest = _unpack(blob)
    seq = (low & np.uint64(127)).astype("<i4")
    seq[low > 127] |= rest.astype("<i4") << 7
    return seq


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of sorted runs that begin at ``starts``; each run's first number as it is."""
    out = np.diff(x, prepend=x[:1])
    out[starts] = x[starts]
    return out


def _summed(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    c = np.cumsum(steps)
    return c - np.repeat(c[starts] - steps[starts], np.diff(np.append(starts, len(steps))))


def _word_hashes(words: list[bytes], lang: np.ndarray, langs: list[str]) -> np.ndarray:
    seeds = [xxhash.xxh64_intdigest(x.encode()) for x in langs]
    digests = b"".join(xxhash.xxh3_128_digest(w, seeds[at]) for w, at in zip(words, lang.tolist()))
    return np.frombuffer(digests, "<u8").reshape(-1, 2)


class _State:
    """A block at a level: ``seq`` holds at each place the number (from 1) of the frequent
    phrase that begins there, or 0; per phrase its number in the corpus, its total, the number of
    its last word, its language and its text. At level 0 the phrases are all single words, without
    numbers or totals."""

    def __init__(self, seq, id, f, last, lang, text, langs, block=None):
        self.seq, self.id, self.f, self.last, self.lang = seq, id, f, last, lang
        self.text, self.langs, self.block = text, langs, block or uuid.uuid4().hex

    def row(self, found=()) -> pa.RecordBatch:
        cells = [self.block, _pack_places(self.seq), *map(_pack, (self.id, self.f, self.last, self.lang)),
                 _squeeze(b"\n".join(self.text)), self.langs, list(found)]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _STATE_ARROW)], schema=_STATE_ARROW)

    @classmethod
    def read(cls, rows: pa.RecordBatch | pa.Table, i: int) -> _State:
        seq, *packed, text = (rows.column(c)[i].as_py() for c in _PACKED)
        arrays = (_unpack(x)[0].astype(kind) for x, kind in zip(packed, ("<u8", "<i8", "<u8", "<i4")))
        text = zstandard.ZstdDecompressor().decompress(text)
        return cls(_unpack_places(seq), *arrays, text.split(b"\n") if text else [],
                   rows.column("langs")[i].as_py(), rows.column("block")[i].as_py())

    def extensions(self, level: int):
        """The block's phrases of ``level`` words, as far as their parts are frequent: counts,
        prefix and rest (numbers from 0; the rest ends with the next word), and the places in
        ``seq`` with the phrase at each."""
        if level == 1:
            n = np.bincount(self.seq, minlength=len(self.text) + 1)[1:]
            index = np.arange(len(n))
            return n, index, index, None
        places = np.flatnonzero((self.seq[:-1] > 0) & (self.seq[1:] > 0))
        key = (self.seq[places].astype(np.int64) - 1) << 32 | (self.seq[places + 1].astype(np.int64) - 1)
        key, which, n = np.unique(key, return_inverse=True, return_counts=True)
        return n, key >> 32, key & 0xFFFFFFFF, (places, which)

    def stripes(self, level: int, buckets: int, extensions=None):
        """(bucket, phrases in it, blob): prefixes, lengths of their stripes, next words, counts."""
        n, prefix, rest, _ = extensions or self.extensions(level)
        if level == 1:                                            # the stripe of the empty prefix
            both = _word_hashes(self.text, self.lang, self.langs)
            head, following, bucket = np.zeros(len(n), np.uint64), both[:, 0], both[:, 1] % np.uint64(buckets)
        else:
            head, following = self.id[prefix], self.last[rest]
            slices = (1 + self.f[prefix] // _SLICE).astype(np.uint64)
            bucket = (_mix(head) + _mix(following) % slices) % np.uint64(buckets)
        order = np.lexsort((following, head, bucket))
        for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if not len(mine):
                continue
            h = head[mine]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
            yield int(bucket[mine[0]]), mine, _pack(_steps(h[starts], np.zeros(1, np.int64)), np.diff(np.append(starts, len(mine))),
                                                    _steps(following[mine], starts), n[mine])


def _read_stripes(blob: bytes):
    """Prefixes, next words and counts of a blob of _State.stripes."""
    head, size, steps, n = _unpack(blob)
    size = size.astype(np.int64)
    return np.cumsum(head).repeat(size), _summed(steps, np.cumsum(size) - size), n.astype(np.int64)


def _number_words(batches):
    """Level 0: blocks of numbered words; ``found`` has each language's words in all."""
    def fresh():
        return [], [], [], {}, []

    words, langs, lang_of, numbers, parts = fresh()
    size = 0

    def numbers_of(lang: str):
        if lang not in numbers:
            at = len(langs)
            langs.append(lang)

            class Numbers(dict):
                def __missing__(self, word):
                    words.append(word)
                    lang_of.append(at)
                    self[word] = len(words)
                    return len(words)

            numbers[lang] = Numbers({b".": 0})
        return numbers[lang]

    def state():
        seq, lang, none = np.concatenate(parts), np.array(lang_of, "<i4"), np.zeros(0, "<i8")
        often = np.bincount(seq, minlength=len(words) + 1)[1:]
        n = np.bincount(lang, weights=often, minlength=len(langs))
        order = np.argsort(-often, kind="stable")                 # small numbers for frequent words
        number = np.zeros(len(words) + 1, "<i4")
        number[order + 1] = np.arange(1, len(words) + 1)
        return _State(number[seq], none, none, none, lang[order], [words[i] for i in order.tolist()], langs) \
            .row({"lang": x, "phrase": "", "f": int(c)} for x, c in zip(langs, n))

    for batch in batches:
        for at, texts in texts_in_slices(batch.column(1)):
            for lang, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts):
                own = numbers_of(lang)
                for tokens in _tokens(text):
                    if size > _BLOCK_TOKENS:
                        yield state()
                        words, langs, lang_of, numbers, parts = fresh()
                        size, own = 0, numbers_of(lang)
                    parts.append(np.fromiter(map(own.__getitem__, tokens), "<i4", len(tokens)))
                    size += len(tokens)
                parts.append(np.zeros(1, "<i4"))
    if words:
        yield state()


def _give_stripes(level: int, buckets: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                state = _State.read(batch, i)
                for bucket, _, blob in state.stripes(level, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([state.block]),
                                                      pa.array([blob], pa.binary())], ["bucket", "block", "stripes"])
    return run


def _merge(min_count: int, buckets: int):
    """Merge the stripes of a bucket elementwise, number its frequent phrases in the order of
    prefix and next word, and tell every block numbers and totals; the least block that
    holds a phrase has its total negative and reports it."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")                              # the same in every attempt
        parts = [_read_stripes(blob) for blob in rows.column("stripes").to_pylist()]
        prefix, following, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((following, prefix))                   # stable: the least block comes first
        p, f = prefix[order], following[order]
        starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (f[1:] != f[:-1])]))
        total = np.add.reduceat(n[order], starts)
        frequent = total >= min_count
        number = (np.cumsum(frequent) - 1) * buckets + rows.column("bucket")[0].as_py()
        size = np.diff(np.append(starts, len(order)))
        totals, numbers = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        totals[order] = np.where(frequent, total, 0).repeat(size)
        totals[order[starts]] *= -1
        numbers[order] = number.repeat(size)
        out, ends = [], np.cumsum([0, *(len(x[2]) for x in parts)])
        for a, b in zip(ends, ends[1:]):
            at = np.flatnonzero(totals[a:b])
            out.append(_pack(_steps(at.astype(np.uint64), np.zeros(1 if len(at) else 0, np.int64)),
                             np.abs(totals[a:b][at]), totals[a:b][at] < 0,
                             _steps(numbers[a:b][at], np.zeros(1 if len(at) else 0, np.int64))))
        return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "totals": pa.array(out, pa.binary())})
    return run


def _go_on(level: int, buckets: int, last_level: bool):
    """A block's next level from its state and the totals of all its buckets."""
    def run(states: pa.Table, answers: pa.Table) -> pa.Table:
        if not states.num_rows:
            return _STATE_ARROW.empty_table()
        state = _State.read(states, 0)
        n, prefix, rest, pairs = extensions = state.extensions(level)
        total, number, own = np.zeros(len(n), np.int64), np.zeros(len(n), np.uint64), np.zeros(len(n), bool)
        given = dict(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist()))
        for bucket, mine, _ in state.stripes(level, buckets, extensions):
            at, totals, owned, numbers = _unpack(given[bucket])
            here = mine[np.cumsum(at.astype(np.int64))]
            total[here], own[here], number[here] = totals, owned, np.cumsum(numbers)
        keep = np.flatnonzero(total)
        local = np.zeros(len(n) + 1, "<i4")                       # the last one stands for no phrase
        local[keep] = np.arange(1, len(keep) + 1)
        p, r = prefix[keep], rest[keep]
        if level == 1:
            seq = local[state.seq - 1]                            # place 0 - 1 is the last
            text, last = [state.text[i] for i in keep], number[keep]
        else:
            seq = np.zeros(len(state.seq), "<i4")
            places, which = pairs
            seq[places] = local[which]
            text = [state.text[a] + b" " + state.text[b].rsplit(b" ", 1)[-1] for a, b in zip(p, r)]
            last = state.last[r]
        found = [{"lang": state.langs[state.lang[p[i]]], "phrase": text[i].decode(), "f": int(total[keep[i]])}
                 for i in np.flatnonzero(own[keep])]
        used = seq > 0
        used[1:] |= seq[:-1] > 0                                  # one gap between runs is enough
        if last_level:                                            # nothing goes on
            used, keep, p, last, text = used[:0], keep[:0], p[:0], last[:0], []
        new = _State(seq[:len(used)][used], number[keep], total[keep], last, state.lang[p], text, state.langs, state.block)
        return pa.Table.from_batches([new.row(found)])
    return run


def frequent_phrases(df: DataFrame, min_count: int = 100, max_words: int = 5, lang_col: str = "lang",
                     text_col: str = "text") -> DataFrame:
    """(lang, phrase, words, f): every phrase of up to ``max_words`` words found at least
    ``min_count`` times in texts of its language, and for each language the empty phrase
    with the number of all its words (0 words).

    A level's blocks are deleted once the next level is written; what they found is kept apart."""
    narrow = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    def told(level: int) -> DataFrame:
        return written(state.select(F.explode("found").alias("x")).select("x.*"), f"phrases-told-{level}")

    state = written(narrow.mapInArrow(_number_words, _STATE), "phrases-0")
    found = [told(0).groupBy("lang").agg(F.sum("f").alias("f")).select("lang", F.lit("").alias("phrase"), F.lit(0).alias("words"), "f")]
    words = found[0].agg(F.sum("f")).collect()[0][0] or 0
    buckets = 1 + words // _BUCKET_TOKENS
    for level in range(1, max_words + 1):
        before, blocks = state, state.drop("found")
        merged = blocks.mapInArrow(_give_stripes(level, buckets), "bucket long, block string, stripes binary") \
            .groupBy("bucket").applyInArrow(_merge(min_count, buckets), "bucket long, block string, totals binary")
        state = written(blocks.groupBy("block").cogroup(merged.groupBy("block"))
                        .applyInArrow(_go_on(level, buckets, level == max_words), _STATE), f"phrases-{level}")
        remove(before)
        found.append(told(level).select("lang", "phrase", F.lit(level).alias("words"), "f"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def collocations(df: DataFrame, min_count: int = 100, max_words: int = 5, subsumed: int = 100, top: int | None = 2000,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` (None: all) phrases of each language.

    a counts the phrase, l and r the parts of its weakest cut, n all words of the language;
    score = floor(1000 a n / (l r)) in exact decimals. A phrase is left out if some longer
    phrase around it has ``subsumed`` percent or more of its count: a longer one is never
    more frequent than those inside it, so looking one word to each side is enough.
    Null texts are empty, a null language is ``und``; repeated rows count each time; texts of any
    length are read whole. Without frequent phrases, or in an empty table, no rows come back."""
    known = written(frequent_phrases(df, min_count, max_words, lang_col, text_col), "phrases-found")
    phrases = known.filter("words > 0").select("lang", "phrase", "words", "f")
    several = phrases.filter("words > 1")
    first = F.expr("substring_index(phrase, ' ', words - 1)")
    rest = F.expr("substring_index(phrase, ' ', 1 - words)")
    longer = several.filter("words > 2").select("lang", "f", F.explode(F.array(first, rest)).alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = several.join(longer, ["lang", "phrase"], "left") \
        .filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(subsumed) * F.col("f")))
    cuts = kept.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")) \
        .select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
                F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    totals = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    wide = "decimal(19, 0)"
    scored = cuts.join(part.select("lang", F.col("part").alias("first"), F.col("part_f").alias("l")), ["lang", "first"]) \
        .join(part.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r")), ["lang", "rest"]) \
        .join(totals, "lang") \
        .withColumn("score", F.expr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
