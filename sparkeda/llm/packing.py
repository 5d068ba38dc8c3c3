"""Best-fit packing (operator 1), bulk-synchronous.

Documents and gaps (the room left in open sequences) are kept in size order. One round
is a successor sweep: sizes are swept upwards and every gap takes the largest waiting
document that fits, which is the same as every document taking the smallest gap at or
above its length. Many documents that want the same gap size are told apart by rank:
the i-th document of a length takes the i-th gap of a size. Gaps shrink, and the next
round starts; when hardly any document fits, new sequences are opened.

Between rounds only the numbers of documents and gaps of each size pass the barrier, at
most ``capacity`` numbers of each, whatever the size of the data. The rows themselves
are swept in parallel: documents get their rank within their length once (salted, so a
length that a third of all documents share is split), every sequence walks through the
rounds on its own and names the (length, rank) it takes in each, and one join on those
unique pairs brings documents and places together.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import ByteBpe, texts_in_slices

_SALTS = 64
_RANK_BITS = 44            # (size, rank) as one sortable number


@dataclass
class Round:
    """What every sequence needs to know of one round."""
    opened: int             # sequences opened before the sweep: numbers, first rank among empty gaps
    first_sequence: int
    first_rank: int
    key: np.ndarray         # intervals by (gap size, first gap rank), sorted
    count: np.ndarray
    length: np.ndarray      # the length and first document rank each interval takes
    doc_rank: np.ndarray
    new_rank: np.ndarray    # first rank among gaps of the size that is left
    taken: np.ndarray       # gaps taken of each size; the others move up by so many


def _sweep(docs: np.ndarray, gaps: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, gap size, how many) matched in one sweep upwards over the sizes, for
    documents of ``least`` tokens or more."""
    waiting, out = [], []
    for size in range(1, len(docs)):
        if docs[size] and size >= least:
            waiting.append([size, int(docs[size])])
        room = int(gaps[size])
        while room and waiting:
            length, n = waiting[-1]
            k = min(room, n)
            out.append((length, size, k))
            room -= k
            if n == k:
                waiting.pop()
            else:
                waiting[-1][1] -= k
    return out


def plan_rounds(lengths: dict[int, int], capacity: int, bands: tuple[int, ...] = (4, 8, 16)) \
        -> tuple[list[Round], int]:
    """All rounds for the given numbers of documents per length; also the number of
    sequences. Longer documents are placed first: those of at least capacity/4 tokens
    until none is left, then capacity/8 and so on (``bands``), then all. When a sweep
    places none, as many sequences are opened as the waiting tokens fill."""
    docs, gaps = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        docs[length] = n
    sizes = np.arange(capacity + 1)
    doc_rank = np.zeros(capacity + 1, np.int64)
    rounds, sequences = [], 0
    floors = [max(1, capacity // b) for b in bands] + [1]
    while docs.any():
        while not docs[floors[0]:].any():
            floors.pop(0)
        least, opened, first_rank = floors[0], 0, int(gaps[capacity])
        matched = _sweep(docs, gaps, least)
        if not matched:
            # documents over half the capacity never share: each needs its own sequence
            opened = int(docs[capacity // 2 + 1:].sum()) or -(-int((docs * sizes)[least:].sum()) // capacity)
            gaps[capacity] += opened
            matched = _sweep(docs, gaps, least)
        taken = np.zeros(capacity + 1, np.int64)
        rows = []
        for length, size, k in matched:
            rows.append([size, int(taken[size]), k, length, int(doc_rank[length]), 0])
            taken[size] += k
            doc_rank[length] += k
            docs[length] -= k
        gaps -= taken
        for r in rows:
            r[5] = int(gaps[r[0] - r[3]])
            gaps[r[0] - r[3]] += r[2]
        a = np.array(rows, dtype=np.int64).reshape(-1, 6)
        key = (a[:, 0] << _RANK_BITS) | a[:, 1]
        a = a[np.argsort(key)]
        rounds.append(Round(opened, sequences, first_rank, np.sort(key), a[:, 2], a[:, 3], a[:, 4], a[:, 5], taken))
        sequences += opened
    return rounds, sequences


def _walk(sequence: np.ndarray, rounds: list[Round], capacity: int):
    """(length, doc rank, sequence, offset) arrays each round's matches give."""
    size = np.full(len(sequence), -1, dtype=np.int64)
    rank = np.zeros(len(sequence), dtype=np.int64)
    for r in rounds:
        fresh = (sequence >= r.first_sequence) & (sequence < r.first_sequence + r.opened)
        size[fresh] = capacity
        rank[fresh] = r.first_rank + sequence[fresh] - r.first_sequence
        i = np.searchsorted(r.key, (size << _RANK_BITS) | rank, side="right") - 1
        j = np.maximum(i, 0)
        within = rank - (r.key[j] & ((1 << _RANK_BITS) - 1))
        hit = (size > 0) & (i >= 0) & (r.key[j] >> _RANK_BITS == size) & (within < r.count[j])
        if hit.any():
            h = j[hit]
            yield r.length[h], r.doc_rank[h] + within[hit], sequence[hit], capacity - size[hit]
        rest = ~hit & (size > 0)
        rank[rest] -= r.taken[size[rest]]
        rank[hit] = r.new_rank[j[hit]] + within[hit]
        size[hit] -= r.length[j[hit]]


def best_fit_pack(items: DataFrame, capacity: int, length_col: str = "length", sequence_col: str = "sequence_id",
                  offset_col: str = "offset") -> DataFrame:
    """Add the sequence and the place in it to every item (its length 1..capacity).

    ``items`` is written once to the checkpoint folder (with a row number), as its counts
    and then its rows are read. Items of one sequence follow each other without gaps from
    offset 0. Ties: items of one length take their places in row order. An empty table
    gives no rows."""
    spark = items.sparkSession
    own = items.columns
    salted = items.withColumn("__uid", F.monotonically_increasing_id()) \
        .withColumn("__salt", F.pmod(F.xxhash64("__uid"), F.lit(_SALTS)).cast("int")) \
        .withColumn("__len", F.col(length_col).cast("int"))
    salted = cut_lineage(salted)
    counts = salted.groupBy("__len", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__len").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # at most one number per length: bounded by the capacity, not by the data
    lengths = {r["__len"]: r["n"] for r in counts.groupBy("__len").agg(F.sum("__n").alias("n")).collect()}
    rounds, sequences = plan_rounds(lengths, capacity)
    mine = Window.partitionBy("__len", "__salt").orderBy("__uid")
    ranked = salted.withColumn("__row", F.row_number().over(mine).cast("long")) \
        .join(offsets.select("__len", "__salt", "__first"), ["__len", "__salt"]) \
        .withColumn("__rank", F.col("__first") + F.col("__row") - 1)
    shared = spark.sparkContext.broadcast(rounds)

    def walk(batches):
        for batch in batches:
            for arrays in _walk(np.asarray(batch.column(0)).astype(np.int64), shared.value, capacity):
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays],
                                                 ["length", "rank", "sequence", "offset"])

    places = spark.range(sequences).mapInArrow(walk, "length long, rank long, sequence long, offset long") \
        .select(F.col("length").cast("int").alias("__len"), F.col("rank").alias("__rank"),
                F.col("sequence").alias("__sequence"), F.col("offset").alias("__offset"))
    return ranked.join(places, ["__len", "__rank"]).select(
        *[F.col(f"`{c}`") for c in own], F.col("__sequence").alias(sequence_col), F.col("__offset").alias(offset_col))


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every text's ids plus ``end_id``.

    Returns (id_col, piece, start, length, ids_crc32) and, ``with_ids``, the ids. Only
    longer texts are cut: the first piece takes the remainder, all others are full.
    Null text counts as empty and is one piece holding just the end id."""
    model = df.sparkSession.sparkContext.broadcast(ByteBpe.load(tokenizer_path))
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe = model.value
        for batch in batches:
            for at, texts in texts_in_slices(batch.column(1)):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(bpe.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(at + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int64))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {narrow.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return narrow.mapInArrow(run, schema + (", ids array<long>" if with_ids else "")).withColumnRenamed("id", id_col)


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every text packed into sequences of at most ``capacity`` tokens."""
    return best_fit_pack(token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), capacity)
