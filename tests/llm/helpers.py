"""Small tables and brute-force twins for the operators of the training-data pipeline."""

import random
import re

import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG_TEXT = ("lorem ipsum dolor sit amet consectetur " * 9000) + "x" * 5000


def edge_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts."""
    texts = [None, "", " ", "\n\t", "a", "A b", "a b", "a b c", "A B C", "it's  DON'T\n\n 12 é ü", LONG_TEXT,
             "one two three four five six seven", "one two three four five six seven", "中文 текст <|endoftext|> end",
             "mail a.b@c.de and +1 (415) 555-1234, 4111 1111 1111 1111, 10.0.0.255"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[5], rows[11], (None, "no id here", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same table with extra columns named like the operators' own."""
    for c in ("id", "h", "key", "fp", "length", "piece", "start", "component_id", "fingerprint", "term", "__len",
              "rank", "score", "sequence_id", "terms", "entity", "node", "root"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(7))
    return df


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# -- brute-force twins -------------------------------------------------------------------
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=3):
    """fp -> representative over all pairs within the bit distance."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    """kind:start:end of every valid match, straight from the definitions."""
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            s = m[0]
            digits = [int(c) for c in s if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in s.split(".")):
                continue
            if kind == "card":
                odd = digits[::-1]
                total = sum(odd[::2]) + sum(sum(divmod(2 * d, 10)) for d in odd[1::2])
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def random_texts(n, seed=3):
    r = random.Random(seed)
    alphabet = list("ab1 .@+-()4é\n") + ["😀", "10.2.3.4", "4111-1111 1111 1111", "x@y.zz", "+44 20 7946 0958"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)]
