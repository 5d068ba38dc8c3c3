"""Language-model scoring (operator 5) with a weighted back-off automaton.

Every training word (and the text end) is a history: a state of the automaton. The arcs of a
state are all word pairs seen at least ``min_pair`` times in training, weighted by absolute
discounting; its failure arc leads to the empty history with the state's left-over
probability, whose arcs are the add-one smoothed single words. A ``state_share`` above 0
leaves out words that make up less of the training tokens, and pairs with such a word. A text is scored in one left-to-right pass
that carries the state (the word just read) and adds up log-probabilities.

The model is never in one place. Texts are numbered once, in blocks of bounded size (or
one longer text). Every block asks for the counts of its own words, then of its own pairs, as
sorted numbers packed into buckets; a bucket adds the counts of all blocks up and answers each
of them, for pairs together with what their history's arcs take of its probability. So a block
meets its part of the automaton and no more, memory is bounded by a block or a bucket, and
what is gathered grows with the corpus. Pairs of a very frequent word are dealt over several
buckets. Words are told apart by 64 bits of a hash within a bucket dealt by another 64, pairs by the
numbers their words get there.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_in_slices
from .phrases import _mix, _pack, _read_stripes, _steps, _summed, _unpack
from .tables import remove, written

END = b""                    # the text end; no word is empty
_BLOCK_TOKENS = 2_000_000
_BUCKET_TOKENS = 4_000_000   # tokens for one bucket; no more than so many entries fall to it
_SLICE = 1 << 20             # occurrences of a history for one bucket of its pairs
_BEYOND = 1 << 62            # numbers from here on stand for no word


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, split at ASCII white space only."""
    return (text or "").encode().lower().split()


def held_out(id_col: str, folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _number(id_type: pa.DataType):
    """Blocks of numbered texts: (block, ids, held, sizes, seq, words); every text ends with 0, the end."""
    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    def block(numbers, ids, held, parts):
        pack = zstandard.ZstdCompressor(level=3).compress
        sizes = np.array([len(p) for p in parts], "<i8")
        cells = [uuid.uuid4().hex, ids, held, sizes.tobytes(), pack(np.concatenate(parts).tobytes()), pack(b"\n".join(numbers))]
        kinds = [pa.string(), pa.list_(id_type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)],
                                          ["block", "ids", "held", "sizes", "seq", "words"])

    def run(batches):
        numbers, ids, held, parts, size = Numbers({END: 0}), [], [], [], 0
        for batch in batches:
            for at, texts in texts_in_slices(batch.column(2)):
                rows = zip(batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(1).slice(at, len(texts)).to_pylist(), texts)
                for i, h, text in rows:
                    words = tokens(text)
                    words.append(END)
                    parts.append(np.fromiter(map(numbers.__getitem__, words), "<i4", len(words)))
                    ids.append(i)
                    held.append(h)
                    size += len(words)
                    if size > _BLOCK_TOKENS:
                        yield block(numbers, ids, held, parts)
                        numbers, ids, held, parts, size = Numbers({END: 0}), [], [], [], 0
        if parts:
            yield block(numbers, ids, held, parts)
    return run


def _column(rows, name: str, i: int):
    return rows.column(name)[i].as_py()


def _plain(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _read_seq(rows, i: int):
    """Word numbers of a block's texts, their lengths, and which tokens are of training texts."""
    seq, sizes = np.frombuffer(_plain(_column(rows, "seq", i)), "<i4"), np.frombuffer(_column(rows, "sizes", i), "<i8")
    return seq, sizes, np.repeat(~np.array(_column(rows, "held", i), bool), sizes)


def _word_requests(rows, i: int, buckets: int):
    """(bucket, words in it, blob) of a block: hashes and training counts of all its words."""
    seq, _, train = _read_seq(rows, i)
    words = _plain(_column(rows, "words", i)).split(b"\n")
    n = np.bincount(seq[train], minlength=len(words))
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    bucket = h[:, 1] % np.uint64(buckets)
    order = np.lexsort((h[:, 0], bucket))
    for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        yield int(bucket[mine[0]]), mine, _pack(_steps(h[mine, 0], np.zeros(1, np.int64)), n[mine])


class _Pairs:
    """The pairs of a block: before each token stands the word before it, or an end."""

    def __init__(self, rows, i: int, least: float):
        self.seq, self.sizes, self.train = _read_seq(rows, i)
        self.count, self.number = _unpack(_column(rows, "counts", i))
        self.count = self.count.astype(np.int64)
        self.before = np.concatenate([np.zeros(1, np.int32), self.seq[:-1]])
        key, self.which = np.unique(self.before.astype(np.int64) << 32 | self.seq, return_inverse=True)
        self.n = np.bincount(self.which[self.train], minlength=len(key))
        self.prefix, self.next = key >> 32, key & 0xFFFFFFFF
        state = self.count >= least
        state[0] = True
        self.asked = np.flatnonzero(state[self.prefix] & state[self.next])
        self.histories = np.unique(self.prefix[state[self.prefix]])

    def requests(self, buckets: int):
        """(bucket, pairs in it, their histories, blob); a history asks in every bucket its pairs lie
        in, whichever of them the block has, as all of them take from its probability."""
        prefix, n = self.prefix[self.asked], self.n[self.asked]
        following, pair = self.number[self.next[self.asked]], self.asked
        slices = 1 + self.count // _SLICE
        wide = self.histories[(slices[self.histories] > 1) | ~np.isin(self.histories, prefix)]
        extra = np.repeat(wide, slices[wide])
        part = np.concatenate([np.arange(slices[w]) for w in wide] or [np.zeros(0, np.int64)])
        piece = np.concatenate([(_mix(following) % slices[prefix].astype(np.uint64)), part.astype(np.uint64)])
        prefix = np.concatenate([prefix, extra])
        following = np.concatenate([following, (part + _BEYOND).astype(np.uint64)])
        n, pair = np.concatenate([n, np.zeros(len(extra), np.int64)]), np.concatenate([pair, np.full(len(extra), -1)])
        head = self.number[prefix]
        bucket = (_mix(head) + piece) % np.uint64(buckets)
        order = np.lexsort((following, head, bucket))
        for mine in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if not len(mine):
                continue
            h = head[mine]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
            yield int(bucket[mine[0]]), pair[mine], prefix[mine[starts]], _pack(
                _steps(h[starts], np.zeros(1, np.int64)), np.diff(np.append(starts, len(mine))), _steps(following[mine], starts), n[mine])


def _requests(of):
    """A mapInArrow step that gives out (bucket, block, asked) for every block; ``of`` makes a block's."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for bucket, *_, blob in of(batch, i):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([_column(batch, "block", i)]),
                                                      pa.array([blob], pa.binary())], ["bucket", "block", "asked"])
    return run


def _answer_words(buckets: int):
    """Counts and numbers of the words of a bucket for every block that asks, and, with the
    first one, how many tokens and different words of training texts the bucket has."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        parts = [_unpack(x) for x in rows.column("asked").to_pylist()]
        h, n = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        total = np.add.reduceat(n[order], starts)
        size = np.diff(np.append(starts, len(order)))
        count, number = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        count[order] = total.repeat(size)
        number[order] = (np.arange(len(total)) * buckets + rows.column("bucket")[0].as_py()).repeat(size)
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        out = [_pack(count[a:b], _steps(number[a:b], np.zeros(1, np.int64))) for a, b in zip(ends, ends[1:])]
        first = np.arange(len(out)) == 0
        return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "answer": pa.array(out, pa.binary()),
                         "n": pa.array(first * int(total.sum())), "v": pa.array(first * int((total > 0).sum()))})
    return run


def _with_counts(buckets: int, id_type: pa.DataType):
    """A block whose words have counts and numbers in the place of their text."""
    kinds = {"block": pa.string(), "ids": pa.list_(id_type), "held": pa.list_(pa.bool_()), "sizes": pa.binary(), "seq": pa.binary(),
             "counts": pa.binary(), "n": pa.int64(), "v": pa.int64()}

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.schema(list(kinds.items())).empty_table()
        given = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()))
        found = [(mine, *_unpack(given[bucket])) for bucket, mine, _ in _word_requests(blocks, 0, buckets)]
        size = sum(len(f[0]) for f in found)
        count, number = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        for mine, c, steps in found:
            count[mine], number[mine] = c, np.cumsum(steps)
        cells = {**{c: _column(blocks, c, 0) for c in ("block", "ids", "held", "sizes", "seq")}, "counts": _pack(count, number),
                 "n": sum(answers.column("n").to_pylist()), "v": sum(answers.column("v").to_pylist())}
        return pa.table({c: pa.array([cells[c]], k) for c, k in kinds.items()})
    return run


def _answer_pairs(min_pair: int, discount: float):
    """Counts of the pairs of a bucket that are arcs (0: none), and what the arcs in it take of
    each history's probability, times its count, for every block that asks."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        parts = [_read_stripes(x) for x in rows.column("asked").to_pylist()]
        prefix, following, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((following, prefix))
        p, f = prefix[order], following[order]
        new = np.concatenate([[True], p[1:] != p[:-1]])
        starts = np.flatnonzero(new | np.concatenate([[True], f[1:] != f[:-1]]))
        total = np.add.reduceat(n[order], starts)
        total = np.where(total >= min_pair, total, 0)
        heads = np.flatnonzero(new[starts])                       # first pair of each history
        kept = np.add.reduceat(np.where(total > 0, total - discount, 0.0), heads)
        history = p[starts][heads]
        count = np.zeros(len(n), np.int64)
        count[order] = total.repeat(np.diff(np.append(starts, len(order))))
        out, ends = [], np.cumsum([0, *(len(x[0]) for x in parts)])
        for a, b in zip(ends, ends[1:]):
            own = prefix[a:b][np.concatenate([[True], prefix[a:b][1:] != prefix[a:b][:-1]])]
            out.append(_pack(count[a:b], kept[np.searchsorted(history, own)].view("<u8")))
        return pa.table({"bucket": rows.column("bucket"), "block": rows.column("block"), "answer": pa.array(out, pa.binary())})
    return run


def _score(buckets: int, n_train: int, vocabulary: int, least: float, discount: float, id_type: pa.DataType):
    """Scores of a block's texts, once its part of the automaton is put together."""
    kinds = {"id": id_type, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(),
             "base_score": pa.float64(), "score": pa.float64()}
    log_all = np.log10(n_train + vocabulary + 1.0)

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return pa.schema(list(kinds.items())).empty_table()
        pairs = _Pairs(blocks, 0, least)
        given = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()))
        arc, kept = np.zeros(len(pairs.n), np.int64), np.zeros(len(pairs.count))
        for bucket, mine, histories, _ in pairs.requests(buckets):
            count, share = _unpack(given[bucket])
            arc[mine[mine >= 0]] = count[mine >= 0]
            kept[histories] += share.view("<f8")
        known = np.maximum(pairs.count, 1)
        single = np.log10(pairs.count + 1.0) - log_all            # arcs of the empty history
        left_over = np.maximum(1e-12, 1.0 - kept / known)         # weights of the failure arcs
        # an arc of the state adds its discounted share; the failure arc always gives its weight
        weight = np.where(arc > 0, (arc - discount) / known[pairs.prefix], 0.0)
        p = left_over[pairs.before] * 10.0 ** single[pairs.seq] + weight[pairs.which]
        start = np.cumsum(pairs.sizes) - pairs.sizes
        sums = [np.add.reduceat(x, start) for x in ((pairs.count[pairs.seq] > 0).astype(np.int64), single[pairs.seq], np.log10(p))]
        cells = [_column(blocks, "ids", 0), _column(blocks, "held", 0), pairs.sizes, sums[0], np.full(len(start), n_train, np.int64), *sums[1:]]
        return pa.table({c: pa.array(x, k) for (c, k), x in zip(kinds.items(), cells)})
    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_share: float = 0.0,
                min_pair: int = 2, discount: float = 0.75) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Training texts are those not held out. Null and empty texts have one token, the end.
    Rows without an id train. Texts of any length are scored whole; one longer than a block
    is a block of its own. Equal rows give equal rows; an empty table gives an empty result. If a
    block meets a word nobody counted the job fails instead of guessing."""
    from pyspark.sql.pandas.types import to_arrow_type
    rows = df.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType
    arrow_id, id_sql = to_arrow_type(id_type), id_type.simpleString()
    texts = f"block string, ids array<{id_sql}>, held array<boolean>, sizes binary, seq binary"
    numbered = written(rows.mapInArrow(_number(arrow_id), f"{texts}, words binary"), "lm-numbered")
    size = numbered.agg(F.sum(F.length("sizes") / 8 + F.length("seq"))).collect()[0][0] or 0
    buckets = 1 + int(size) // _BUCKET_TOKENS                     # a packed token takes a byte or two
    asked = "bucket long, block string, asked binary"
    words = numbered.mapInArrow(_requests(lambda b, i: _word_requests(b, i, buckets)), asked) \
        .groupBy("bucket").applyInArrow(_answer_words(buckets), "bucket long, block string, answer binary, n long, v long")
    counted = written(numbered.groupBy("block").cogroup(words.groupBy("block"))
                      .applyInArrow(_with_counts(buckets, arrow_id), f"{texts}, counts binary, n long, v long"), "lm-counted")
    remove(numbered)
    total = counted.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()[0]
    n_train, vocabulary = total["n"] or 0, total["v"] or 0
    least = max(1.0, state_share * n_train)
    pairs = counted.mapInArrow(_requests(lambda b, i: _Pairs(b, i, least).requests(buckets)), asked) \
        .groupBy("bucket").applyInArrow(_answer_pairs(min_pair, discount), "bucket long, block string, answer binary")
    scored = counted.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(
        _score(buckets, n_train, vocabulary, least, discount, arrow_id),
        f"id {id_sql}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
