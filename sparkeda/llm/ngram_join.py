"""N-gram Jaccard self-join (operator 11) with PartEnum signatures.

A document is the set of its distinct word shingles. Two sets of sizes n and m with a
Jaccard similarity of at least s differ in at most (n + m) (1 - s) / (1 + s) elements.
Sizes are cut into bands, each reaching to its start divided by s squared, so a pair lies in one
band or two neighbours; a set is signed for its own band and, where it can meet larger ones, for the next. For a band, whose pairs
differ in at most k elements, the domain of the shingle hashes is partitioned in two
levels: one of the n1 first-level parts holds at most k2 differences, so of its n2 cells
some n2 - k2 hold none, and the two sets agree there. All subsets of n2 - k2 cells are
enumerated; the elements a set has in a subset are its signature, and similar sets share one.
Small sets (k up to 3) use one part of k + 3 cells, larger ones many parts of two cells.
Empty subsets say nothing and give no signature; a set with so few cells filled that a
similar one might share none of them is signed once more over ever more cells.

Groups of equal signatures are made in buckets of bounded size from packed hashes. Equal
sets are one class throughout. Candidates become links in rounds: a member is compared with one
class of its group, links give components, and only groups that still hold several
components go on; at the end these give their pairs between components. Pairs are sieved
by a parity sketch (which bounds their differences from below, so it loses none) and
then measured on the whole sets, packed as differences of 48-bit hashes.

Similar sets share not one but many signatures: all filled cells but those with a difference. So
a member need only stay in the smallest of its groups, as many as it has more than it surely shares
with any similar set, and one; with groups in one order, two similar sets still meet (the prefix
filter). Sets that have fewer groups than that drop out. So passages that many documents share make no
large groups of documents that have text of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import texts_in_slices
from .components import connected_components
from .tables import written

_CHUNK = 4_000_000            # bytes of a text split at once
_ENOUGH = 1_000_000           # set elements signed at once
_FLUSH = 2_000_000            # signatures dealt to buckets at once
_BUCKET = 4_000_000           # signatures of a bucket
_SKETCH = 16                  # longs of a parity sketch
_BROADCAST_BYTES = 8 << 20    # of class numbers
_FIRST = 64                   # of a member's groups that it names to others
_WORDS = 300_000              # word hashes remembered by a task
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = [np.uint64(f) for f in np.random.default_rng(11).integers(1, 2 ** 62, 64) * 2 + 1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _word_hashes(text: str | None, known: _WordHashes) -> np.ndarray:
    data, at, out = (text or "").encode(), 0, []
    while at < len(data):
        end = at + _CHUNK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = data[at:end].translate(_LOWER).split()
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
        if len(known) > _WORDS:
            known.clear()
    return out[0] if len(out) == 1 else np.concatenate([*out, np.zeros(0, np.uint64)])


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    return h[keep]


def _sets_of(texts: list[str | None], size: int, known: _WordHashes) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of ``size`` words; one of all its words if
    they are fewer. Shingles of all the texts are hashed together, where they do not cross an end."""
    each = [_word_hashes(t, known) for t in texts]
    w = np.concatenate([*each, np.zeros(0, np.uint64)])
    h = np.full(max(0, len(w) - size + 1), np.uint64(size))
    for i in range(size):
        h += w[i:len(w) - size + 1 + i] * _FACTORS[i]
    h = _mix(h)
    out, at = [], 0
    for x in each:
        n = len(x)
        if n >= size:
            out.append(_distinct(h[at:at + n - size + 1]))
        elif n:
            out.append(_mix((x * np.array(_FACTORS[:n])).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(x)
        at += n
    return out


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    return _sets_of([text], size, _WordHashes())[0]


def _sets(batches, size: int):
    """(batch, first row, sets) of slices of bounded text."""
    known = _WordHashes()
    for batch in batches:
        for at, texts in texts_in_slices(batch.column(batch.num_columns - 1)):
            yield batch, at, _sets_of(texts, size, known)


def _class(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


class _Bands:
    """Bands of set sizes for a similarity of ``percent`` hundredths."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("signatures need a similarity above one half")
        first, last = [1], []
        while first[-1] < 1 << 40:
            last.append(max(first[-1], first[-1] * 10_000 // percent ** 2))
            first.append(last[-1] + 1)
        self.percent, self.first = percent, np.array(first[:-1])
        self.k = 2 * np.array(last) * (100 - percent) // (100 + percent)

    def of(self, n: np.ndarray, step: int):
        """Band (own + step) of each size, and whether a set of that size is signed for it."""
        band = np.searchsorted(self.first, n, side="right") - 1 + step
        return band, (100 * n >= self.percent * self.first[band]) if step else np.ones(len(n), bool)


def _cells(elements: np.ndarray, n: np.ndarray, cells: np.ndarray):
    """Filled cells of many sets: (set, cell, sum of the elements' hashes); a set's elements are
    sorted and cells are ranges of the hash domain, so no sort is needed."""
    total = np.repeat(cells.astype(np.uint64), n)
    at = ((elements >> np.uint64(32)) * total >> np.uint64(32)).astype(np.int64)
    start = np.cumsum(cells) - cells
    place = np.repeat(start, n) + at
    edges = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    sums = np.add.reduceat(_mix(elements + np.uint64(1)), edges)
    which = np.searchsorted(start, place[edges], side="right") - 1
    return which, place[edges] - start[which], sums


def _signed(sums, band, level, part):
    salt = (band.astype(np.uint64) << np.uint64(40)) + (np.uint64(level) << np.uint64(32)) + part.astype(np.uint64)
    return _mix(sums + _mix(salt + np.uint64(0x632BE59BD9B4E019)))


def signatures(sets: list[np.ndarray], bands: _Bands):
    """(set, band, level, agreeing, signature) arrays over non-empty sets. ``agreeing`` is how
    many signatures at least a set shares at this level with any similar set; 0 if none is sure and
    the next level follows."""
    n_all = np.array([len(s) for s in sets])
    begin = np.cumsum(n_all) - n_all
    all_elements = np.concatenate(sets)
    for step in (0, 1):
        band_all, asked = bands.of(n_all, step)
        level, todo = 0, np.flatnonzero(asked)
        while len(todo):
            n, band = n_all[todo], band_all[todo]
            k = bands.k[band]
            differ = np.minimum(k, n * (100 - bands.percent) // bands.percent)    # of a similar set, at most
            take = np.repeat(begin[todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            elements = all_elements[take]
            if level:
                cells = (k + 1) << level
            else:
                cells = np.where(k == 0, 1, np.where(k <= 3, k + 3, 2 * -(-13 * (k + 1) // 16)))
            which, cell, sums = _cells(elements, n, cells)
            filled = np.bincount(which, minlength=len(todo))
            small = (k > 0) & (k <= 3) if level == 0 else np.zeros(len(k), bool)
            agreeing = np.where(small, filled > differ, filled - differ).clip(0)
            flat = ~small[which]
            yield (todo[which[flat]], band[which[flat]], level, agreeing[which[flat]],
                   _signed(sums[flat], band[which[flat]], level, cell[flat]))
            for kk in np.unique(k[small]):                        # subsets of 3 of k + 3 cells
                own = np.flatnonzero(small & (k == kk))
                here = np.isin(which, own)
                table = np.zeros((len(own), kk + 3), np.uint64)
                table[np.searchsorted(own, which[here]), cell[here]] = sums[here]
                for number, subset in enumerate(combinations(range(kk + 3), 3)):
                    value = table[:, subset]
                    some = (value != 0).any(axis=1)
                    yield (todo[own[some]], band[own[some]], level, agreeing[own[some]],
                           _signed(value[some].sum(axis=1, dtype=np.uint64), band[own[some]], level,
                                   np.full(some.sum(), number)))
            todo, level = todo[agreeing == 0], level + 1


def _give_signatures(size: int, bands: _Bands, buckets: int, id_type: pa.DataType):
    """(bucket, blob): packed signatures, with class, band, level and sure agreements of each
    entry, that is of each set, band and level; and (bucket below 0, id, key, n, c) of every row."""
    names = ["bucket", "blob", "id", "key", "n", "c"]

    def members_of(batch, at, sets, found):
        k = len(sets)
        return pa.RecordBatch.from_arrays(
            [pa.array(-1 - (at + np.arange(k)) % buckets, pa.int64()), pa.nulls(k, pa.binary()), batch.column(0).slice(at, k),
             batch.column(1).slice(at, k), pa.array([len(s) for s in sets], pa.int64()), pa.array(found, pa.int64())], names)

    def packed(parts):
        number, base = [], 0
        for p in parts:                                           # sets of one band step and level
            number.append(p[0] + base)
            base += int(p[0].max(initial=0)) + 1
        number = np.concatenate(number)
        c, band, level, agreeing, sig = (np.concatenate(x) for x in list(zip(*parts))[1:])
        bucket = ((sig & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket * base + number)
        number, sig, bucket = (x[order] for x in (number, sig, bucket))
        entry = np.concatenate([[0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(number) != 0)) + 1])
        count = np.diff(np.append(entry, len(sig)))
        c, band, level, agreeing = (x[order] for x in (c, band, level, agreeing))
        short = np.ascontiguousarray((sig >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[entry])) + 1, [len(entry)]])
        at = np.append(entry, len(sig))
        for a, b in zip(cuts, cuts[1:]):
            e = entry[a:b]
            blob = b"".join([np.array([b - a], "<u4").tobytes(), c[e].astype("<i8").tobytes(), band[e].astype("<u2").tobytes(),
                             level[e].astype("u1").tobytes(), np.minimum(agreeing[e], 65535).astype("<u2").tobytes(),
                             count[a:b].astype("<u4").tobytes(), short[at[a]:at[b]].tobytes()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[e[0]])], pa.int64()), pa.array([blob], pa.binary()), pa.nulls(1, id_type), pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)

    def run(batches):
        held, elements, parts, ready, met = [], 0, [], 0, set()
        classes = []

        def sign():
            nonlocal ready
            c = np.array(classes, np.int64)
            for which, band, level, agreeing, sig in signatures(held, bands):
                parts.append((which, c[which], band.astype(np.int32), np.full(len(which), level, np.int16), agreeing, sig))
                ready += len(sig)
            held.clear()
            classes.clear()

        for batch, at, sets in _sets(batches, size):
            found = [_class(s) if len(s) else None for s in sets]
            yield members_of(batch, at, sets, found)
            for s, c in zip(sets, found):
                if c is None or c in met:
                    continue
                met.add(c)
                held.append(s)
                classes.append(c)
                elements += len(s)
                if elements > _ENOUGH:
                    sign()
                    elements = 0
                    if ready > _FLUSH:
                        yield from packed(parts)
                        parts, ready, met = [], 0, set()
        if held:
            sign()
        if ready:
            yield from packed(parts)
    return run


def _unpack(blob: bytes):
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    at, out = 4, []
    for kind, width in (("<i8", 8), ("<u2", 2), ("u1", 1), ("<u2", 2), ("<u4", 4)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += width * n
    count = out.pop()
    short = np.zeros((int(count.sum()), 8), np.uint8)
    short[:, :5] = np.frombuffer(blob, np.uint8, offset=at).reshape(-1, 5)
    return [x.repeat(count) for x in out], short.view("<u8").ravel()


_GROUPS = [("g", pa.int64()), ("c", pa.int64()), ("band", pa.int32()), ("level", pa.int32()),
           ("agreeing", pa.int32()), ("size", pa.int64()), ("times", pa.int64())]
_GROUPS_SQL = "g long, c long, band int, level int, agreeing int, size long, times long"


def _groups(rows: pa.Table) -> pa.Table:
    """Groups of several classes with an equal signature in one bucket; each set of classes once,
    and how often (``times``) it was such a group. Rows of documents pass."""
    if rows.column("bucket")[0].as_py() < 0:
        return pa.table({**{name: rows.column("c") if name == "c" else pa.nulls(rows.num_rows, kind) for name, kind in _GROUPS},
                         **{name: rows.column(name) for name in ("id", "key", "n")}})
    found = _bucket_groups(rows)
    return pa.table({**found, "id": pa.nulls(len(found["g"]), rows.schema.field("id").type), "key": pa.nulls(len(found["g"]), pa.string()),
                     "n": pa.nulls(len(found["g"]), pa.int64())})


def _bucket_groups(rows: pa.Table) -> dict:
    parts = [_unpack(blob) for blob in rows.column("blob").to_pylist()]
    sig = np.concatenate([p[1] for p in parts])
    c, band, level, agreeing = (np.concatenate(x) for x in zip(*(p[0] for p in parts)))
    del parts
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    edge = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.flatnonzero(edge)
    low, high = (f.reduceat(c[order], start) for f in (np.minimum, np.maximum))
    several = np.repeat(low != high, np.diff(np.append(start, len(s))))
    order = order[several]
    order = order[np.lexsort((c[order], sig[order]))]             # members by class; copies side by side
    s, cc = sig[order], c[order]
    if len(order):
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (cc[1:] != cc[:-1])])
        order, s, cc = order[first], s[first], cc[first]
    else:
        return {name: pa.array([], kind) for name, kind in _GROUPS}
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(start, len(s)))
    g = np.add.reduceat(_mix(cc.view(np.uint64) + np.uint64(3)), start)
    g = _mix(g + size.astype(np.uint64) * _FACTORS[0] + band[order][start].astype(np.uint64) * _FACTORS[1]
             + level[order][start].astype(np.uint64) * _FACTORS[2])
    _, keep, again = np.unique(g, return_index=True, return_counts=True)
    once = np.zeros(len(g), np.int64)
    once[keep] = again
    rows_of = np.repeat(once, size)
    chosen = np.flatnonzero(rows_of)
    group = np.repeat(np.arange(len(g)), size)[chosen]
    o = order[chosen]
    values = (g[group].view(np.int64), cc[chosen], band[o], level[o], agreeing[o], size[group], rows_of[chosen])
    return {name: pa.array(v, kind) for (name, kind), v in zip(_GROUPS, values)}


def _members_and_groups(keyed: DataFrame, size: int, bands: _Bands) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, c) of every row, and (g, c, least): groups of classes that may hold similar
    pairs; every similar pair shares one."""
    from pyspark.sql.pandas.types import to_arrow_type
    chars = keyed.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    buckets = 1 + chars // (6 * _BUCKET)                          # about six characters a signature, or fewer signatures
    kind = keyed.schema["id"].dataType
    rows = f"id {kind.simpleString()}, key string, n long"
    found = keyed.mapInArrow(_give_signatures(size, bands, buckets, to_arrow_type(kind)), f"bucket long, blob binary, {rows}, c long") \
        .groupBy("bucket").applyInArrow(_groups, f"{_GROUPS_SQL}, {rows}")
    found = written(found, "join-groups")
    members, found = found.filter("n is not null").select("id", "key", "n", "c"), found.filter("n is null")
    # the prefix filter: each member's smallest groups, as many as may hold no similar set and one
    own = ["c", "band", "level"]
    each = found.repartition(*own).groupBy(*own, "g").agg(
        F.sum("times").alias("times"), F.max("size").alias("size"), F.max("agreeing").alias("agreeing"))
    by_size = Window.partitionBy(*own).orderBy("size", "g")
    kept = each.withColumn("upto", F.sum("times").over(by_size) - F.col("times")) \
        .withColumn("all", F.sum("times").over(Window.partitionBy(*own))).filter("upto <= all - agreeing").select("g", "c")
    bounds = kept.groupBy("g").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").drop("most")
    groups = written(kept.join(bounds, "g").select("g", "c", "least"), "join-candidates")
    return members, groups


_BITS = np.uint64(16)         # left out of a hash when two sets are compared element by element


def _pack_set(s: np.ndarray) -> bytes:
    """A sorted set's hashes without their last bits, as differences in planes of bytes."""
    steps = np.diff(s >> _BITS, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:6]).tobytes())


def _unpack_set(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel())


def _with_sketch(size: int):
    """(c, a, rep, n, sketch, elements) of each packed text; rows of the same text follow each other."""
    def run(batches):
        known, before = _WordHashes(), None
        for batch in batches:
            classes = batch.column(0).to_pylist()
            new = [i for i, c in enumerate(classes) if c != (classes[i - 1] if i else before)]
            before = classes[-1] if classes else before
            for at in range(0, len(new), 64):
                take = new[at:at + 64]
                unpack = zstandard.ZstdDecompressor().decompress
                sets = _sets_of([unpack(batch.column(3)[i].as_py()).decode() for i in take], size, known)
                n = np.array([len(s) for s in sets], np.int64)
                place = _mix(np.concatenate(sets)) % np.uint64(64 * _SKETCH) + np.repeat(np.arange(len(sets), dtype=np.uint64), n) * np.uint64(64 * _SKETCH)
                odd = np.bincount(place.astype(np.int64), minlength=len(sets) * 64 * _SKETCH) & 1
                sketch = np.packbits(odd.astype(np.uint8).reshape(len(sets), -1), axis=1).view(np.int64)
                offsets = pa.array(np.arange(len(sets) + 1) * _SKETCH, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(pa.array(take)) for k in range(3)), pa.array(n),
                     pa.ListArray.from_arrays(offsets, pa.array(sketch.ravel())), pa.array([_pack_set(s) for s in sets], pa.binary())],
                    ["c", "a", "rep", "n", "sketch", "elements"])
    return run


def _packed_texts(batches):
    """(id, key, packed text): texts as they go to the tasks of their classes."""
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=3).compress
        for at, texts in texts_in_slices(batch.column(2)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)),
                 pa.array([pack((t or "").encode()) for t in texts], pa.binary())], ["id", "key", "packed"])


_ALIKE = " + ".join(f"bit_count(get(asketch, {i}) ^ get(bsketch, {i}))" for i in range(_SKETCH))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.toDF(*(side if c == "c" else f"{side}{c}" for c in df.columns))


def _open(percent: int) -> str:
    return f"{percent} * greatest(an, bn) <= 100 * least(an, bn) AND ({_ALIKE}) <= ((an + bn) * {100 - percent}) div {100 + percent}"


def _maybe(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and parity sketches leave the similarity open."""
    return pairs.filter(_open(percent))


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    def run(batches):
        for batch in batches:
            keep, last = [], (None, None)
            for i in range(batch.num_rows):
                blob = batch.column(2)[i].as_py()
                if last[0] != blob:                               # pairs of one class follow each other
                    last = blob, _unpack_set(blob)
                x, y = last[1], _unpack_set(batch.column(3)[i].as_py())
                both = np.sort(np.concatenate([x, y]))
                both = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                yield batch.select([0, 1]).take(pa.array(keep))

    return pairs.select("a", "b", "aelements", "belements").mapInArrow(run, "a long, b long")


def _pairs_once(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (g, c, root, n, sketch) of one group and different roots that
    ``_maybe`` leaves open. Two members may share very many groups: each row names the first of its
    member's groups, and a pair is given out by the first that both name, not by each group it shares.
    Where the first shared one is not among them, the pair comes from several groups, and never from none."""
    firsts = members.select("c", "g").withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy("g"))) \
        .filter(F.col("at") <= _FIRST).groupBy("c").agg(F.collect_list("g").alias("firsts"))
    named = members.join(firsts, "c")
    one, two = (named.select("g", *[F.col(x).alias(side if x == "c" else f"{side}{x}") for x in ("c", "root", "n", "sketch", "firsts")])
                for side in "ab")
    # the lists are met only for pairs that the sieve leaves
    once = "coalesce(array_min(array_intersect(afirsts, bfirsts)) >= g, true)"
    return one.join(two, "g").filter(f"CASE WHEN aroot < broot AND {_open(percent)} THEN {once} ELSE false END") \
        .select("a", "b")


def links(groups: DataFrame, sets: DataFrame, percent: int, rounds: int = 1) -> DataFrame:
    """(node, root) of the classes linked by similar pairs. ``sets`` has every class's partner of
    the first round (``a``) and whether it is one (``rep``)."""
    whole = ["c", "n", "sketch", "elements"]
    # every class with the class it meets most often among the least of its groups: the only
    # round that moves the sets of all classes, once to their partner's
    first = sets.filter("a is not null").select("a", *[F.col(c).alias(c if c == "a" else "b" if c == "c" else f"b{c}") for c in whole]) \
        .join(_side(sets.filter("rep").select(*whole), "a"), "a")
    found = cut_lineage(_similar(_maybe(first, percent), percent))
    for at in range(rounds + 1):
        root = cut_lineage(connected_components(found))
        named = groups.join(root, groups["c"] == root["node"], "left").select("g", "c", F.coalesce("root", "c").alias("root"))
        mixed = named.groupBy("g").agg(F.min(F.struct("root", "c")).alias("lo"), F.max("root").alias("hi")) \
            .filter("lo.root <> hi").select("g", "lo")
        open_groups = written(named.join(mixed, "g"), "join-open")
        short = sets.select("c", "n", "sketch")
        if at < rounds:
            # one pair for each two components that meet: the star of the least component
            pairs = open_groups.filter("root <> lo.root").groupBy("root", "lo.root") \
                .agg(F.max(F.struct(F.xxhash64("c", F.lit(at)), F.col("lo.c").alias("a"), F.col("c").alias("b"))).alias("p")) \
                .select("p.a", "p.b")
            pairs = _maybe(pairs.join(_side(short, "a"), "a").join(_side(short, "b"), "b"), percent).select("a", "b")
        else:
            # sizes and sketches go along, so the join itself gives out only pairs that may be similar
            pairs = _pairs_once(open_groups.select("g", "c", "root").join(short, "c"), percent).distinct()
        pairs = written(pairs, "join-pairs")
        asked = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        elements = sets.select("c", "elements")
        if 8 * asked.count() <= _BROADCAST_BYTES:                 # else all sets move to the join
            elements = elements.join(F.broadcast(asked), "c", "left_semi")
        found = cut_lineage(found.union(_similar(pairs.join(_side(elements, "a"), "a").join(_side(elements, "b"), "b"), percent)).distinct())
    return connected_components(found)


def similar_documents(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: the number of distinct shingles of
    ``size`` words and the smallest id reachable over links, its own included. Two documents link if
    the Jaccard similarity of their sets is at least ``percent`` hundredths.

    Words are cut at ASCII white space, A-Z lower-cased; texts of fewer words are one shingle.
    Null and empty texts and those without words have the empty set, link with nothing and keep
    their own id. Whole texts of any length are read. Equal rows give equal rows; rows
    without an id link like others but are never the smallest id, and a component without any
    id has a null component_id. An empty table gives an empty result. Shingles and sets are
    told apart by 64-bit hashes, of which 48 bits are compared between two sets."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = narrow.select("id", F.md5("text").alias("key"), "text")
    members, groups = _members_and_groups(keyed, size, _Bands(percent))
    # the sets of the classes in those groups, each from one of its texts
    most = groups.filter("least <> c").groupBy("c", "least").count() \
        .groupBy("c").agg(F.max(F.struct("count", "least")).alias("m")).select("c", F.col("m.least").alias("a"))
    most = cut_lineage(groups.select("c").distinct().join(most, "c", "left"))
    reps = most.select(F.col("a").alias("c")).distinct().withColumn("rep", F.lit(True))
    asked = members.join(most, "c").groupBy("c").agg(F.min(F.struct("key", "id")).alias("one"), F.first("a").alias("a")) \
        .join(reps, "c", "left").select("c", "one.key", "one.id", "a", F.coalesce("rep", F.lit(False)).alias("rep"))
    id_type = narrow.schema["id"].dataType.simpleString()
    packed = keyed.mapInArrow(_packed_texts, f"id {id_type}, key string, packed binary")
    texts = packed.join(asked, packed["key"].eqNullSafe(asked["key"]) & packed["id"].eqNullSafe(asked["id"])).select("c", "a", "rep", "packed")
    sets = written(texts.mapInArrow(_with_sketch(size), "c long, a long, rep boolean, n long, sketch array<long>, elements binary"),
                   "join-sets")
    root = cut_lineage(links(groups, sets, percent))
    classes = members.filter("c is not null").groupBy("c").agg(F.min("id").alias("first"))
    rooted = classes.join(root, classes["c"] == root["node"], "left").select("c", "first", F.coalesce("root", "c").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    per_class = rooted.join(least, "root").select("c", "component_id")
    # a class may hold a third of all rows: AQE splits that partition of the join
    return members.join(per_class, "c", "left") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
