"""Language identification (operator 8).

One interpolated Kneser-Ney character model per language, kept in sorted hash arrays: for
each order the hashes of the n-grams with their interpolated log-probabilities, and the
hashes of the contexts with their back-off weights. Texts are scored in Arrow batches:
the distinct n-grams of a batch are looked up once per language by binary search and
gathered back, the language with the lowest cross-entropy per character wins. A text is
rejected when that cross-entropy lies above what held-back labelled texts of the
winning language show at its length, or when guessing evenly among that language's
characters would do as well.

The models are fitted on a bounded sample of labelled rows (``sample_docs`` per language
by hash order, ``sample_chars`` code points per language in all); everything else
covers all rows and whole texts.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import texts_in_slices

ORDER = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)     # odd multiplier of the rolling hash
_SPACE = 32


@dataclass
class Model:
    lang: str
    grams: list[np.ndarray]      # per order 1..ORDER: sorted n-gram hashes
    logp: list[np.ndarray]       # and their interpolated natural log-probabilities
    contexts: list[np.ndarray]   # per order: sorted hashes of contexts (order - 1 characters)
    logw: list[np.ndarray]       # and their log back-off weights
    unseen: float                # log-probability of a character never seen
    mean: float = 0.0            # of the cross-entropy of held-back texts,
    spread: float = 0.0          # its deviation between long texts
    noise: float = 0.0           # and per character
    uniform: float = 0.0         # cross-entropy of guessing evenly among the model's characters


def normalise(text: str) -> np.ndarray:
    """Code points, lower-cased, each run of non-letters one blank, blanks around; empty
    without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, dtype=np.uint32)
    keep = letter | np.append(False, letter[:-1])        # letters and the first mark after them
    out = np.where(letter, cp, _SPACE)[keep]
    out = out[np.argmax(out != _SPACE):]
    return np.concatenate([[_SPACE], out, [] if out[-1] == _SPACE else [_SPACE]]).astype(np.uint32)


def _letters() -> np.ndarray:
    from .bpe import _LETTER, _classes
    if not hasattr(_letters, "table"):
        _letters.table = _classes() == _LETTER
    return _letters.table


def _hashes(cp: np.ndarray) -> list[np.ndarray]:
    """For each order n the hash of the n characters that end at every place; places with
    fewer characters before them hold the hash of what is there."""
    c = (cp.astype(np.uint64) + np.uint64(1)) * _MUL
    c ^= c >> np.uint64(29)
    out = [c * _MUL]
    for _ in range(ORDER - 1):
        before = np.append(np.zeros(1, np.uint64), out[-1][:-1])
        out.append((before ^ (before >> np.uint64(31))) * _MUL + c)
    return out


def _lookup(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
    return at, (table[at] == key) if len(table) else np.zeros(len(key), dtype=bool)


def fit(lang: str, texts: list[np.ndarray]) -> Model:
    """Interpolated Kneser-Ney model of the normalised texts: counts at the highest order,
    continuation counts (distinct characters before) below it."""
    per_text = [_hashes(t) for t in texts]
    alphabet = max(2, len(np.unique(np.concatenate(texts))))
    unseen = -np.log(4.0 * alphabet)
    # distinct n-grams of every order with context, shorter n-gram, shorter context
    tables = []
    for n in range(1, ORDER + 1):
        gram = np.concatenate([h[n - 1][n - 1:] for h in per_text])
        ctx = np.concatenate([h[n - 2][n - 2:-1] if n > 1 else np.zeros(len(h[0]), np.uint64) for h in per_text])
        low = np.concatenate([h[n - 2][n - 1:] if n > 1 else np.zeros(len(h[0]), np.uint64) for h in per_text])
        u, first, count = np.unique(gram, return_index=True, return_counts=True)
        tables.append((u, ctx[first], low[first], count.astype(np.float64)))
    grams, logp, contexts, logw = [], [], [], []
    lower = None
    for n in range(1, ORDER + 1):
        u, ctx, low, count = tables[n - 1]
        if n < ORDER:                                     # continuation counts
            longer = tables[n][2]
            at, hit = _lookup(u, longer)
            more = np.bincount(at[hit], minlength=len(u))
            count = np.where(more > 0, more, 1).astype(np.float64)
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        c, inv = np.unique(ctx, return_inverse=True)
        total = np.bincount(inv, weights=count)
        weight = discount * np.bincount(inv) / total
        if n == 1:
            below = np.full(len(u), np.exp(unseen))
        else:
            at, _ = _lookup(grams[-1], low)
            below = lower[at]
        p = (count - discount) / total[inv] + weight[inv] * below
        lower = p
        grams.append(u)
        logp.append(np.log(p).astype(np.float32))
        contexts.append(c)
        logw.append(np.log(weight).astype(np.float32))
    return Model(lang, grams, logp, contexts, logw, float(unseen), uniform=float(np.log(alphabet)))


def log_probabilities(model: Model, hashes: list[np.ndarray], before: list[np.ndarray],
                      depth: np.ndarray) -> np.ndarray:
    """Log-probability of characters given by their n-gram hashes per order, the hashes of
    their contexts and how many characters (at least 1) each n-gram may have."""
    out = np.zeros(len(depth))
    open_ = np.arange(len(depth))
    for n in range(ORDER, 0, -1):
        use = open_[depth[open_] >= n]
        at, hit = _lookup(model.grams[n - 1], hashes[n - 1][use])
        out[use[hit]] += model.logp[n - 1][at[hit]]
        miss = use[~hit]
        if n > 1:
            at, hit2 = _lookup(model.contexts[n - 1], before[n - 2][miss])
            out[miss[hit2]] += model.logw[n - 1][at[hit2]]
        else:
            out[miss] += model.unseen + model.logw[0][0]
        done = np.zeros(len(depth), dtype=bool)
        done[use[hit]] = True
        open_ = open_[~done[open_]]
    return out


def cross_entropies(models: list[Model], texts: list[np.ndarray]) -> np.ndarray:
    """Cross-entropy per character (nats) of non-empty normalised texts, a row each."""
    cp = np.concatenate(texts)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    place = np.arange(len(cp)) - np.repeat(start, size)
    h = _hashes(cp)
    depth = np.minimum(place + 1, ORDER)
    # one key for the longest n-gram at a place; shorter ones at the start of a text
    top = h[ORDER - 1].copy()
    for n in range(1, ORDER):
        top[depth == n] = h[n - 1][depth == n] ^ np.uint64(n)
    _, first, inv = np.unique(top, return_index=True, return_inverse=True)
    here = [x[first] for x in h]
    before = [np.append(np.zeros(1, np.uint64), x[:-1])[first] for x in h]
    out = np.empty((len(texts), len(models)))
    for k, m in enumerate(models):
        lp = log_probabilities(m, here, before, depth[first])
        out[:, k] = -np.add.reduceat(lp[inv], start) / size
    return out


def entropies_of(models: list[Model], texts: list[str | None], limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropies, characters) of raw texts; rows without letters have 0 characters.
    Long texts are scored in windows of ``limit`` characters whose sums are added up."""
    total, chars = np.zeros((len(texts), len(models))), np.zeros(len(texts), dtype=np.int64)
    waiting: list[tuple[int, np.ndarray]] = []

    def flush():
        if waiting:
            for (i, t), ce in zip(waiting, cross_entropies(models, [t for _, t in waiting])):
                total[i] += ce * len(t)
                chars[i] += len(t)
            waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        t = normalise(text) if text else np.zeros(0, np.uint32)
        for at in range(0, len(t), limit):
            waiting.append((i, t[at:at + limit]))
            held += len(waiting[-1][1])
            if held >= limit:
                flush()
                held = 0
    flush()
    return total / np.maximum(chars, 1)[:, None], chars


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """Model of one language (a bounded group) with its held-back texts' entropies."""
    texts = [normalise(t) for t in pdf["text"]]
    back = pdf["held_back"].to_numpy()
    fit_on = [t for t, b in zip(texts, back) if len(t) and not b] or [t for t in texts if len(t)]
    if not fit_on:
        return pd.DataFrame({"lang": [], "model": []})
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "model": [pickle.dumps(fit(pdf["lang"].iloc[0], fit_on))]})


def train_models(labelled: DataFrame, sample_docs: int = 600, sample_chars: int = 4_000_000) -> "Classifier":
    """Fit one model per language on labelled rows (id, text, lang), bounded as said above.

    Rows without text, language or letters teach nothing. A fifth of the sample is held
    back to calibrate rejection and confidence."""
    rows = labelled.select("id", "text", "lang").filter("text is not null and lang is not null") \
        .filter(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("id", "text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Classifier([], 1.0)
    # hash thresholds that leave some more rows than wanted, then the exact number
    near = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, sample_docs / n * 1.2 + 8 * sample_docs ** 0.5 / n)
        bound = int(-2 ** 63 + share * 2 ** 64) if share < 1 else 2 ** 63 - 1
        near = near | ((F.col("lang") == F.lit(lang)) & (F.col("h") <= F.lit(bound)))
    by_hash = Window.partitionBy("lang").orderBy("h", "id")
    sample = rows.filter(near).withColumn("r", F.row_number().over(by_hash)) \
        .withColumn("chars", F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))) \
        .filter((F.col("r") <= sample_docs) & ((F.col("chars") <= sample_chars) | (F.col("r") == 1))) \
        .select("lang", "text", (F.col("r") % 5 == 0).alias("held_back"))
    found = sample.groupBy("lang").applyInPandas(_train, "lang string, model binary").collect()
    models = sorted((pickle.loads(r["model"]) for r in found), key=lambda m: m.lang)
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        for batch in batches:
            ce, chars = entropies_of(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(ce), pa.list_(pa.float64())),
                                              pa.array(chars)], ["lang", "ce", "chars"])

    seen = sample.filter("held_back").select("lang", "text") \
        .mapInArrow(measure, "lang string, ce array<double>, chars long").collect()
    return _calibrated(models, [(r["lang"], np.array(r["ce"]), r["chars"]) for r in seen])


@dataclass
class Classifier:
    models: list[Model]
    sharpness: float             # of the confidence
    tolerance: float = 16.0      # deviations above the mean at which a text is rejected

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """(language, confidence, rejected, cross-entropy) per text; equal entropies go to
        the smaller language name."""
        if not self.models:
            return [("und", 0.0, True, None)] * len(texts)
        ce, chars = entropies_of(self.models, texts)
        out = []
        for row, n in zip(ce, chars):
            if not n:
                out.append(("und", 0.0, True, None))
                continue
            k = int(np.argmin(row))
            m = self.models[k]
            limit = min(m.uniform, m.mean + self.tolerance * np.sqrt(m.spread ** 2 + m.noise ** 2 / n))
            score = 1.0 / np.exp(-self.sharpness * np.sqrt(n) * (row - row[k])).sum()
            out.append((m.lang, float(score), bool(row[k] > limit), float(row[k])))
        return out


def _calibrated(models: list[Model], seen: list[tuple[str, np.ndarray, int]]) -> Classifier:
    """Rejection limits per language and the confidence's sharpness from held-back texts.

    The spread of the cross-entropy is modelled as that of long texts plus noise per
    character; quantiles instead of moments keep a few mislabelled texts from widening it."""
    pooled = []
    for k, m in enumerate(models):
        own = [(ce[k], n) for lang, ce, n in seen if lang == m.lang and n]
        if not own:
            own = [(-float(np.mean(m.logp[-1])), 100)]
        v, n = np.array([x for x, _ in own]), np.array([x for _, x in own], dtype=float)
        m.mean = float(np.median(v))
        off = np.abs(v - m.mean)
        m.spread = float(max(np.quantile(off[n >= np.median(n)], 0.68), 0.02))
        short = n <= np.median(n)
        m.noise = float(max(np.quantile((off * np.sqrt(n))[short], 0.68), 0.5))
        pooled += [(ce, size, k) for lang, ce, size in seen if lang == m.lang and size]

    def loss(s):
        return sum(np.log(np.exp(-s * np.sqrt(n) * (ce - ce[k])).sum()) for ce, n, k in pooled)

    sharp = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=lambda s: (loss(s) if pooled else 0, s))
    return Classifier(models, sharp)


def identify(df: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected, cross_entropy) for every row, whole texts.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Equal
    rows give equal rows; an empty table gives an empty result. Row-local, no shuffle:
    the models (bounded by the sample) are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(classifier)
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for at, texts in texts_in_slices(batch.column(1)):
                lang, score, rejected, ce = zip(*shared.value.judge(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(rejected, pa.bool_()), pa.array(ce, pa.float64())],
                    ["id", "lang_pred", "score", "rejected", "cross_entropy"])

    schema = f"id {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean, " \
             "cross_entropy double"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int = 4, fold: int = 2):
    """Rows that training must not see: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify_with_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         lang_col: str = "lang") -> DataFrame:
    """Fit on the rows of ``df`` that have a language and are not held out, then judge all.

    The held-out rows, ids and sources are never inputs of a prediction."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    classifier = train_models(rows.filter(~held_out("id")))
    out = identify(rows, classifier, "id", "text")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "rejected",
                      "cross_entropy")


def keep_identified(df: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, unchanged, whose text has a recognised language."""
    shared = df.sparkSession.sparkContext.broadcast(classifier)
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at, texts in texts_in_slices(batch.column(place)):
                keep = [not rejected for _, _, rejected, _ in shared.value.judge(texts)]
                yield batch.slice(at, len(texts)).filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
