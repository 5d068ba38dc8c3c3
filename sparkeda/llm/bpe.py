"""BPE encoding and decoding (operator 4).

Byte-level BPE exactly as a ``tokenizers`` JSON file defines it: texts are split into
words by vectorised character classes, distinct words are merged in batched numpy
rounds, and ids are gathered back per text. One merge round looks every adjacent symbol
pair of many words up by binary search in the sorted pair keys, takes the lowest rank
of each word and applies that merge to the whole batch at once.

Edge cases: null text is the empty text (no ids); the strings of special tokens inside a
text become their ids, as the library does by default; very long texts are processed in
segments cut only where a word must end, so memory does not grow with one text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 19          # code points handled at once (memory bound, not a limit on texts)
CACHE_WORDS = 300_000      # distinct words remembered by a Python worker before it starts afresh
LONG_WORD = 512            # bytes above which one word is merged with a heap instead of in the batch
_NO_RANK = np.int32(2 ** 31 - 1)
# White_Space of the Unicode standard (fixed values)
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# the splitting pattern's contractions (fixed values)
_CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    kind = {"L": _LETTER, "N": _NUMBER}
    out[:] = [kind.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(sys.maxunicode + 1)]
    out[_SPACES] = _SPACE
    return out


def _byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary -> the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _hash_tables(seed: int) -> tuple[np.ndarray, int, int]:
    """A random 64-bit value per byte, an odd multiplier and its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    m = int(rng.integers(2 ** 40, 2 ** 62)) * 8 + 5
    return values, m, pow(m, -1, 2 ** 64)


@functools.lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _word_hashes(raw: bytes, cut: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hash (modulo 2^64) of the bytes between successive cuts."""
    values, m, inverse = _hash_tables(seed)
    n = max(2 * SEGMENT, 1 << len(raw).bit_length())
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[np.frombuffer(raw, dtype=np.uint8)] * _powers(m, n)[:len(raw)], out=total[1:])
    return (total[cut[1:]] - total[cut[:-1]]) * _powers(inverse, n)[cut[:-1]]


class ByteBpe:
    """Tables of one byte-level BPE vocabulary plus its batch encoder and decoder."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normaliser or prefix space is needed")
        letters, vocab = _byte_letters(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * n
        for token, i in vocab.items():
            raw[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.token_len = np.array([len(b) for b in raw], dtype=np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        first, at = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = first, at.astype(np.int32), made[at]
        self._forget()

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    # -- words of a text ------------------------------------------------------------
    def _word_starts(self, cp: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Start of every word in the flat code points; ``breaks`` are starts of
        segments that words never span."""
        n = len(cp)
        kind = _classes()[cp]
        brk = np.zeros(n + 1, dtype=bool)
        brk[breaks] = True
        brk[n] = True
        run = np.ones(n, dtype=bool)
        run[1:] = (kind[1:] != kind[:-1]) | brk[1:n]
        space = kind == _SPACE
        last = np.zeros(n, dtype=bool)               # last white space before a non-space
        last[:-1] = space[:-1] & ~space[1:] & ~brk[1:n]
        joined = np.zeros(n, dtype=bool)             # run that takes the blank before it
        joined[1:] = last[:-1] & (cp[:-1] == 32)
        start = (run & (space | ~joined)) | last
        for p in np.flatnonzero((cp == 39) & run & ~joined):
            for c in _CONTRACTIONS:
                e = p + 1 + len(c)
                if e <= n and not brk[p + 1:e].any() and "".join(map(chr, cp[p + 1:e])) == c:
                    start[p + 1:e] = False
                    if e < n and kind[e] == _LETTER and not brk[e]:
                        start[e] = True
                    break
        return np.flatnonzero(start)

    # -- batched merges ---------------------------------------------------------------
    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words at once: (flat ids, ids per word)."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        done_sym, done_owner = [], []
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            inside = owner[:-1] == owner[1:]
            rank = np.where(inside & (self.keys[at] == key), self.rank[at], _NO_RANK)
            rank = np.append(rank, _NO_RANK)
            first = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            low = np.repeat(lowest, count)
            hit = np.flatnonzero((rank == low) & (low != _NO_RANK))
            if len(hit):                               # overlapping equal pairs: every second one
                fresh = np.append(True, np.diff(hit) != 1)
                run_at = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
                hit = hit[(hit - run_at) % 2 == 0]
                sym = sym.copy()
                sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            over = low == _NO_RANK                     # words without a pair to merge are finished
            done_sym.append(sym[over])
            done_owner.append(owner[over])
            keep &= ~over
            sym, owner = sym[keep], owner[keep]
        if not done_sym:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
        owner, sym = np.concatenate(done_owner), np.concatenate(done_sym)
        order = np.argsort(owner, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One very long word: lowest (rank, place) pair first from a heap."""
        sym = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        table = self._pair_table()
        heap = []

        def offer(i):
            j = right[i]
            if j >= 0 and (hit := table.get((sym[i], sym[j]))):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(len(sym)):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return np.array([s for s in sym if s >= 0], dtype=np.uint32)

    def _pair_table(self):
        if not hasattr(self, "_pairs"):
            self._pairs = {(int(k) >> 32, int(k) & 0xFFFFFFFF): (int(r), int(m))
                           for k, r, m in zip(self.keys, self.rank, self.made)}
        return self._pairs

    def _forget(self):
        """Empty table of merged words: sorted word hashes, their check hashes, numbers."""
        self.known, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.flat, self.size, self.at = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[bytes]) -> np.ndarray:
        """Merge new words and append their ids to the table; their numbers."""
        short = [w for w in words if len(w) <= LONG_WORD]
        ids, size = self._merge(short)
        if len(short) < len(words):                    # put the heap's words among the others
            it = iter(np.split(ids, np.cumsum(size)[:-1]) if short else [])
            parts = [next(it) if len(w) <= LONG_WORD else self._merge_long(w) for w in words]
            ids, size = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        numbers = len(self.size) + np.arange(len(words))
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.size, self.at = np.concatenate([self.size, size]), np.concatenate([self.at, at])
        return numbers

    def _numbers(self, raw: bytes, cut: np.ndarray) -> np.ndarray:
        """Number of each word ``raw[cut[i]:cut[i+1]]`` in this worker's table.

        Words are told apart by two independent 64-bit hashes of their bytes and their
        length; where the two ever disagree, and for words too long to hash safely, the
        bytes themselves decide."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        size = np.diff(cut)
        h, c = (_word_hashes(raw, cut, seed) ^ size.astype(np.uint64) for seed in (1, 2))
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        uc = c[first]
        at = np.minimum(np.searchsorted(self.known, u), max(len(self.known) - 1, 0))
        seen = (self.known[at] == u) if len(self.known) else np.zeros(len(u), dtype=bool)
        clash = (uc[inv] != c).any() or (seen.any() and (self.check[at[seen]] != uc[seen]).any())
        if clash or size.max() > LONG_WORD:
            table: dict[bytes, int] = {}
            words = [raw[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            order = np.array([table.setdefault(w, len(table)) for w in words], dtype=np.int64)
            self._forget()
            return self._add(list(table))[order]
        out = np.empty(len(u), dtype=np.int64)
        out[seen] = self.number[at[seen]]
        if not seen.all():
            new = ~seen
            pick = first[new]
            out[new] = self._add([raw[a:b] for a, b in zip(cut[pick].tolist(), cut[pick + 1].tolist())])
            where = np.searchsorted(self.known, u[new])
            self.known = np.insert(self.known, where, u[new])
            self.check = np.insert(self.check, where, uc[new])
            self.number = np.insert(self.number, where, out[new])
        return out[inv]

    def _segment_ids(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part; parts are encoded on their own."""
        joined = "".join(parts)
        if not joined:
            return [np.zeros(0, dtype=np.uint32)] * len(parts)
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        edge = np.cumsum([0, *map(len, parts)])
        starts = self._word_starts(cp, edge[:-1][np.diff(edge) > 0])
        wide = (1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)).astype(np.int64)
        byte_at = np.concatenate([[0], np.cumsum(wide)])
        number = self._numbers(joined.encode(), np.append(byte_at[starts], byte_at[-1]))
        size = self.size[number]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.at[number] - total[:-1], size) + np.arange(total[-1])]
        word_edge = total[np.searchsorted(starts, edge)]
        return [ids[a:b] for a, b in zip(word_edge, word_edge[1:])]

    # -- texts --------------------------------------------------------------------------
    def _parts(self, text: str):
        """(segment, special id or None): special tokens apart, long texts cut before a
        single blank between two non-blanks, where a word ends in any case."""
        pieces = [(text, None)]
        for token, i in self.special.items():
            if token in text:
                nxt = []
                for s, special in pieces:
                    if special is not None:
                        nxt.append((s, special))
                        continue
                    for k, p in enumerate(s.split(token)):
                        if k:
                            nxt.append(("", i))
                        nxt.append((p, None))
                pieces = nxt
        for s, special in pieces:
            at = 0
            while special is None and len(s) - at > SEGMENT:
                cut = s.find(" ", at + SEGMENT)
                while cut >= 0 and (s[cut - 1].isspace() or cut + 1 >= len(s) or s[cut + 1].isspace()):
                    cut = s.find(" ", cut + 1)
                if cut < 0:
                    break
                yield s[at:cut], None
                at = cut
            yield s[at:], special

    def encode(self, texts) -> "list[np.ndarray]":
        """Ids (uint32) of each text; None counts as empty."""
        out: list[list[np.ndarray]] = []
        waiting: list[tuple[int, int, str]] = []
        held = 0

        def flush():
            nonlocal held
            for (i, k, _), ids in zip(waiting, self._segment_ids([s for _, _, s in waiting])):
                out[i][k] = ids
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            out.append([])
            for s, special in self._parts(text or ""):
                if special is not None:
                    out[i].append(np.array([special], dtype=np.uint32))
                elif s:
                    out[i].append(None)
                    waiting.append((i, len(out[i]) - 1, s))
                    held += len(s)
                    if held >= SEGMENT:
                        flush()
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, dtype=np.uint32) for x in out]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the text of ``ids``: gathered from the token table in slices."""
        out = []
        for a in range(0, len(ids), SEGMENT):
            part = ids[a:a + SEGMENT].astype(np.int64)
            size = self.token_len[part]
            total = np.concatenate([[0], np.cumsum(size)])
            out.append(self.token_bytes[np.repeat(self.token_at[part] - total[:-1], size) + np.arange(total[-1])].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def __getstate__(self):
        own = ("known", "check", "number", "flat", "size", "at", "_pairs")
        return {k: v for k, v in self.__dict__.items() if k not in own}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()


def texts_in_slices(column: pa.Array, limit: int = 2 * SEGMENT):
    """(first row, texts) slices of an Arrow string column, each of about ``limit``
    bytes or one row, so that Python strings of a whole batch never exist at once."""
    at, n = 0, len(column)
    size = np.zeros(n, dtype=np.int64) if not n else np.asarray(
        pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    while at < n:
        end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), limit, side="right")))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def bpe_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns (id_col, n_tokens, ids_sha256, decoded_sha256) and, ``with_ids``, the ids
    (array<long>) and the decoded text. Row-local: no shuffle; the vocabulary (fixed
    size) is broadcast. Null text counts as empty; repeated rows each give a row; an
    empty table gives an empty result."""
    model = df.sparkSession.sparkContext.broadcast(ByteBpe.load(tokenizer_path))
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        bpe = model.value
        for batch in batches:
            keys = batch.column(0)
            for at, texts in texts_in_slices(batch.column(1)):
                n, ids_hash, text_hash, all_ids, decoded = [], [], [], [], []
                for ids in bpe.encode(texts):
                    raw = bpe.decode_bytes(ids)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text = raw.decode("utf-8", errors="replace")
                    text_hash.append(hashlib.sha256(text.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int64))
                        decoded.append(text)
                cols = [keys.slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()),
                        pa.array(text_hash, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<long>, decoded string" if with_ids else ""
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
