"""URL filters (operator 9): rules by host and path, and a logistic regression on hashed
character n-grams of host and path for the URLs that no rule decides.

Only DataFrame, SQL and Spark ML. The regression is trained from a small labelled URL
table (url, label 1 = block); without one, URLs that the rules decide serve as labels,
thinned by hash to about ``label_rows``.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (action, host, path): a host stands for itself and all its subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url) -> tuple:
    """Columns host and path of a url column; both empty when null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Add ``rule`` (host + path of the longest rule that fits, else null) and ``action`` to
    rows with host and path. The stated rules are few and travel with the plan."""
    listed = F.array(*[F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"),
                                F.lit(h).alias("h"), F.lit(p).alias("p")) for a, h, p in rules])
    fits = F.filter(listed, lambda r: ((F.col("host") == r.h) | F.endswith(F.col("host"), F.concat(F.lit("."), r.h)))
                    & F.startswith(F.col("path"), r.p))
    return df.withColumn("__r", F.array_max(fits)).withColumn("rule", F.col("__r.rule")) \
        .withColumn("action", F.col("__r.action")).drop("__r")


def _grams(n: int):
    """Character n-grams of host and path, the host marked at both ends."""
    text = F.concat(F.lit("^"), F.col("host"), F.lit("$"), F.col("path"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def _features(df: DataFrame, sizes: tuple[int, ...], buckets: int) -> DataFrame:
    grams = df.withColumn("__grams", F.concat(*[_grams(n) for n in sizes]))
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=buckets).transform(grams).drop("__grams")


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4), buckets: int = 1 << 15, steps: int = 20,
          regularise: float = 1e-3):
    """Logistic regression from (url, label); the constant class when there is only one,
    null labels and urls being left out. None without labels."""
    rows = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select(host.alias("host"), path.alias("path"), "label")
    classes = sorted(r["label"] for r in rows.select("label").distinct().limit(3).collect())
    if len(classes) < 2:
        return classes[0] if classes else None
    return LogisticRegression(featuresCol="__features", labelCol="label", maxIter=steps, regParam=regularise) \
        .fit(_features(rows, sizes, buckets))


def labels_from_rules(judged: DataFrame, label_rows: int = 20_000) -> DataFrame:
    """(url, label) of distinct urls that a rule decides, thinned by hash to about
    ``label_rows`` rows: the documented bound on what the classifier is fitted on."""
    urls = judged.filter("rule is not null and url is not null") \
        .select("url", F.when(F.col("action") == "block", 1.0).otherwise(0.0).alias("label")).distinct()
    n = urls.count()
    if n <= label_rows:
        return urls
    return urls.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < F.lit(int((1 << 30) * label_rows / n)))


def filter_urls(df: DataFrame, labelled: DataFrame | None = None, rules=RULES, id_col: str = "page_id",
                url_col: str = "url", threshold: float = 0.5, sizes: tuple[int, ...] = (3, 4), buckets: int = 1 << 15) -> DataFrame:
    """(id_col, host, path, rule, verdict, block_probability) for every row.

    The rule's verdict where one fits, else block when the regression's probability is
    above ``threshold``. Null urls and urls without ``://`` have empty host and path and are
    judged like any other; without labels the method allows. Row-local but for the
    training; equal rows give equal rows, an empty table an empty result."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    judged = with_rule(rows.select("id", "url", host.alias("host"), path.alias("path")), rules)
    model = train(labels_from_rules(judged) if labelled is None else labelled, sizes, buckets)
    if model is None or isinstance(model, float):
        scored = judged.withColumn("p", F.lit(model or 0.0).cast("double"))
    else:
        model.setFeaturesCol("__features")
        scored = model.transform(_features(judged, sizes, buckets)).withColumn("p", vector_to_array("probability")[1])
    verdict = F.coalesce("action", F.when(F.col("p") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"),
                         F.col("p").alias("block_probability"))
