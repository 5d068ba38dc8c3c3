"""SimHash near-duplicates (operator 10) by meet-in-the-middle ball hashing.

Texts get a 64-bit fingerprint of their word shingles; fingerprints link when they differ
in at most ``max_bits`` (3) bits. Work is done on distinct fingerprints only. Every
fingerprint emits the variants within its half of the radius - one flipped bit for all,
two flipped bits for fingerprints of even parity - and variants are the shuffle key. Two
fingerprints that meet at a variant one flip from the first and one or two flips from
the second are within the radius by the triangle inequality, so everything at a variant
is linked to one fingerprint that is at most one flip away: a star, linear in the
members and without all pairs. That covers every pair: differences of 1 or 2 bits meet
among the one-flip variants; with 3 bits the parities differ, so the odd one flips one
bit and the even one two. Of the three ways to split the three bits, the one whose two
bits are closest on the circle of 64 is enough (their distance is at most 21), which saves
a third of the two-flip variants. A variant has at most 1 + 64 + 1344 members, a bound
that does not depend on the data.

The two-flip balls are large, so a cheap exact sieve goes first: of any pair within 3
bits, one 32-bit half differs in at most one bit. Only fingerprints whose half (with at
most one flip) equals the half of another distinct fingerprint emit their balls; all
others cannot have a partner.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import texts_in_slices
from .components import connected_components

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SLICE = 1 << 16           # shingles whose bits are counted at once


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a text (repeats count); 0 without words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        h = np.fromiter((hash64(" ".join(words[i:i + shingle]), seed) for i in range(at, min(n, at + _SLICE))),
                        dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for at, texts in texts_in_slices(batch.column(1)):
                fp = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(fp)], ["id", "fp"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - 2 ** 64 if mask >= 2 ** 63 else mask


def _two_flips() -> list[int]:
    """Masks of two bits whose distance on the circle of 64 bits is at most 21."""
    return [_signed(1 << i | 1 << j) for i in range(64) for j in range(i + 1, 64) if min(j - i, 64 - j + i) <= 21]


def _longs(values: list[int]):
    return F.expr("array(" + ",".join(f"{v}L" if v != -2 ** 63 else "shiftleft(1L, 63)" for v in values) + ")")


def _spread(fps: DataFrame, per_task: int) -> DataFrame:
    """Fingerprints dealt evenly over tasks before each of them gives many rows."""
    spark = fps.sparkSession
    return fps.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-fps.count() // per_task)), "fp")


def _with_possible_partner(fps: DataFrame) -> DataFrame:
    """Fingerprints that share a 32-bit half, up to one flipped bit, with another one."""
    halves = F.array(F.struct(F.lit(0).alias("side"), F.expr("shiftrightunsigned(fp, 32)").alias("half")),
                     F.struct(F.lit(1).alias("side"), F.expr("fp & 4294967295L").alias("half")))
    own = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.side", "h.half")
    # every half as it is, and with each bit flipped; a key seen by two fingerprints, at
    # least one of them unflipped, marks all that emitted it
    flips = own.select("fp", "side", "half", F.explode(_longs([0, *(1 << i for i in range(32))])).alias("m"))
    keys = flips.select("fp", F.expr("(half ^ m) * 2 + side").alias("key"), F.expr("m = 0L").alias("plain"))
    met = keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.max("plain").alias("plain")) \
        .filter("plain and lo <> hi").select("key")
    return keys.join(met, "key", "left_semi").select("fp").distinct()


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Star edges (a, b) whose components are those of all pairs within ``max_bits`` bits,
    over distinct fingerprints ``fp``."""
    if max_bits != 3:
        raise ValueError("the balls are laid out for a radius of 3 bits")
    fps = _spread(cut_lineage(_with_possible_partner(_spread(cut_lineage(fps), 20_000))), 2_000)
    one = fps.select("fp", F.explode(_longs([0, *(_signed(1 << i) for i in range(64))])).alias("m")) \
        .select(F.expr("fp ^ m").alias("variant"), "fp", F.lit(True).alias("near"))
    two = fps.filter("bit_count(fp) % 2 = 0").select("fp", F.explode(_longs(_two_flips())).alias("m")) \
        .select(F.expr("fp ^ m").alias("variant"), "fp", F.lit(False).alias("near"))
    at = one.union(two).groupBy("variant").agg(
        F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.min("fp").alias("lo"), F.max("fp").alias("hi"),
        F.collect_set("fp").alias("all"))         # at most 1 + 64 + 1344 by construction
    return at.filter("a is not null and lo <> hi").select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def simhash_components(df: DataFrame, shingle: int = 3, seed: int = 42, max_bits: int = 3, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) for every row: 16 hex digits of the
    fingerprint and the smallest id reachable over links of at most ``max_bits`` bits.

    Null and empty texts have the fingerprint zero, which links like any other. Null ids
    stay; a component of null ids only has a null component_id. Equal rows give equal
    rows. An empty table gives an empty result."""
    rows = cut_lineage(fingerprints(df, shingle, seed, id_col, text_col))
    by_fp = rows.groupBy("fp").agg(F.min("id").alias("first"))
    comp = cut_lineage(connected_components(links(by_fp.select("fp"), max_bits)))
    grouped = by_fp.join(comp, by_fp["fp"] == comp["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    # a fingerprint may hold a third of all rows: AQE splits that partition of the join
    per_fp = grouped.join(least, "root").select("fp", "component_id")
    return rows.join(per_fp, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                          "component_id")
