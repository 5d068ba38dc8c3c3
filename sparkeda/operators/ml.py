"""Predictive analysis on Spark ML.

Everything that decides or measures is a DataFrame aggregate (labels, splits,
folds, weights, metrics, ranking); the models are Spark ML estimators, so both
training and scoring are distributed. Splits and folds are exact per class: rows are
numbered inside their class in the order of a seeded hash, by one range sort (no window
over a whole class).
"""

from __future__ import annotations

import math
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import numeric_value, q, rnd
from ..plans.facts import column_facts
from ..plans.quantiles import exact_quantiles
from ..plans.roles import role_columns, select_prediction_features
from ..session import cut_lineage
from ..sources.io import with_global_index


#: failures of the cluster, not of a model
_CLUSTER_FAULT = re.compile(r"ExecutorLost|FetchFailed|No space left|OutOfMemory|Container .*killed|SparkContext was shut down|"
                            r"Python worker exited unexpectedly")


# ---------------------------------------------------------------- labels, splits
def encode_label(df: DataFrame, col: str, out: str = "label") -> tuple[DataFrame, list[str]]:
    """Classes (as text) -> 0..k-1 in sorted order; returns (frame, classes)."""
    idx = StringIndexer(inputCol="__cls", outputCol=out, stringOrderType="alphabetAsc")
    src = df.withColumn("__cls", q(col).cast("string"))
    model = idx.fit(src)
    return model.transform(src).drop("__cls"), list(model.labels)


def _placed(df: DataFrame, label: str | None, key: list[str], seed: int, salt: str) -> DataFrame:
    """Adds ``__place`` (0-based, in the order of a seeded hash of the key, inside the
    class or over all rows when ``label`` is None), ``__size`` (rows of the class) and
    ``__row`` (a number unique to the row)."""
    h = F.md5(F.concat_ws("|", *[q(c).cast("string") for c in key], F.lit(f"{salt}{seed}")))
    cls = q(label) if label else F.lit(0)
    rows = with_global_index(df.withColumn("__cls", cls).withColumn("__h", h),
                             [F.col("__cls"), F.col("__h"), *[q(c) for c in key]], "__row")
    per = rows.groupBy(F.col("__cls").alias("__c")).agg(F.min("__row").alias("__first"),
                                                        F.count(F.lit(1)).alias("__size"))
    return rows.join(per, F.col("__cls").eqNullSafe(F.col("__c")), "left") \
        .withColumn("__place", F.col("__row") - F.col("__first")).drop("__cls", "__c", "__h", "__first")


def _n_test(test: float) -> F.Column:
    return F.floor(F.col("__size") * F.lit(test) + F.lit(0.5))


def stratified_split(df: DataFrame, label: str | None, key: list[str], test: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """L3: adds ``is_test``: of every class (of all rows when ``label`` is None) the share
    ``test``, rounded half up, in the order of a seeded hash of the row key."""
    return _placed(df, label, key, seed, "split").withColumn("is_test", F.col("__place") < _n_test(test)) \
        .drop("__place", "__size", "__row")


def fold_count(df: DataFrame, label: str, task: str = "classification") -> int:
    """L4: k = min(5, rarest class) when every class has >= 2 rows, else 3; 5 for regression."""
    if task != "classification":
        return 5
    mn = df.groupBy(q(label)).count().agg(F.min("count")).collect()[0][0] or 0
    return min(5, mn) if mn >= 2 else 3


def stratified_folds(df: DataFrame, label: str | None, key: list[str], k: int, seed: int = 42) -> DataFrame:
    """L4: ``fold`` in 0..k-1, dealt in turn inside every class (over all rows when
    ``label`` is None) in the order of a seeded hash of the key."""
    return _placed(df, label, key, seed, "fold").withColumn("fold", (F.col("__place") % k).cast("int")) \
        .drop("__place", "__size", "__row")


def split_and_folds(df: DataFrame, label: str | None, key: list[str], k: int, test: float = 0.2,
                    seed: int = 42, row: str | None = None) -> DataFrame:
    """L3 and L4 by one sort: ``is_test`` as in ``stratified_split``, and ``fold`` dealt over
    the training rows of every class (null for test rows). ``row`` names a column for the
    row's unique number."""
    p = _placed(df, label, key, seed, "split").withColumn("is_test", F.col("__place") < _n_test(test))
    p = p.withColumn("fold", F.when(~F.col("is_test"), ((F.col("__place") - _n_test(test)) % k).cast("int")))
    p = p.withColumnRenamed("__row", row) if row else p.drop("__row")
    return p.drop("__place", "__size")


def class_weights(df: DataFrame, label: str, out: str = "weight", fit_on: DataFrame | None = None) -> DataFrame:
    """L5: 'balanced' weights n / (classes x count(class)), counted over ``fit_on`` (the
    frame itself by default); one tiny aggregate (one row per class, bounded by the class
    cap) broadcast back."""
    counts = (df if fit_on is None else fit_on).groupBy(q(label).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy()  # over the per-class counts: one row per class
    w = counts.select("__c", (F.sum("__n").over(every) / (F.count(F.lit(1)).over(every) * F.col("__n"))).alias(out))
    return df.join(F.broadcast(w), q(label) == F.col("__c"), "left").drop("__c")


def training_warnings(df: DataFrame, label: str, task: str = "classification") -> DataFrame:
    """Imbalance (majority share >= 0.8), small sample (< 200 rows) and
    rare classes (some class below 2 rows: no stratified split); for regression that it is
    one, and a small sample. The texts are fixed values."""
    if task != "classification":
        msgs = F.array(F.lit("Regression task detected (continuous target)."),
                       F.when(F.col("total") < 200,
                              F.lit("Small training sample — regression metrics may be unstable.")))
        return df.agg(F.count(q(label)).alias("total")).select(F.posexplode(msgs).alias("n", "warning")) \
            .filter(F.col("warning").isNotNull())
    counts = df.filter(q(label).isNotNull()).groupBy(q(label)).agg(F.count(F.lit(1)).alias("n"))
    s = counts.agg(F.sum("n").alias("total"), F.max("n").alias("mx"), F.min("n").alias("mn")) \
        .withColumn("majority_share", rnd(F.col("mx") / F.col("total"), 3))
    msgs = F.array(
        F.when(F.col("majority_share") >= 0.8,
               F.lit("Class imbalance detected — consider SMOTE or class_weight='balanced'.")),
        F.when(F.col("total") < 200, F.lit("Small training sample — metrics may be unstable.")),
        F.when(F.col("mn") < 2, F.lit("Stratified split not possible due to rare classes.")))
    return s.select(F.posexplode(msgs).alias("n", "warning")).filter(F.col("warning").isNotNull())


# ---------------------------------------------------------------- features
def prepare_features(df: DataFrame, target: str, primary_keys: list[str] | None = None,
                     max_features: int = 80) -> tuple[DataFrame, list[str], list[str]]:
    """L1: drop rows with a null target, pick features (T11), split them into
    numeric and categorical by role."""
    data = df.filter(q(target).isNotNull())
    facts = column_facts(data)
    feats = select_prediction_features(data, target, facts, max_features, primary_keys).collect()
    chosen = [r["column"] for r in sorted(feats, key=lambda r: (r["role"] != "numeric", r["rank"]))]
    roles = {r["column"]: r["is_numeric"] for r in role_columns(facts, primary_keys=primary_keys).collect()}
    numeric = [c for c in chosen if roles.get(c)]
    categorical = [c for c in chosen if c not in numeric]
    return data.select(*[q(c) for c in chosen + [target]]), numeric, categorical


def impute_scale_encode(df: DataFrame, numeric: list[str], categorical: list[str],
                        out: str = "features", fit_on: DataFrame | None = None) -> tuple[DataFrame, list]:
    """L2: exact-median imputation and standardisation of numeric features;
    most-frequent imputation and one-hot encoding (unseen -> extra slot) of
    categorical ones. Fill values (one per column, driver-sized) are learned from
    ``fit_on``, by default the frame itself; returns the filled frame and the pipeline
    stages to fit."""
    if not numeric and not categorical:
        raise ValueError("no usable feature columns")
    learn = df if fit_on is None else fit_on
    fields = {f.name: f.dataType for f in df.schema.fields}
    vals = {c: numeric_value(c, fields[c]) for c in numeric}
    meds = exact_quantiles(learn, vals, [0.5]) if numeric else {}
    modes = {}
    if categorical:
        from .stats import value_counts
        modes = {r["column"]: r["value"]
                 for r in value_counts(learn, categorical, top=1, include_null=False).collect()}
    fill = {c: F.coalesce(vals[c], F.lit(meds[(c, 0.5)] or 0.0)) for c in numeric}
    fill |= {c: F.coalesce(q(c).cast("string"), F.lit(modes.get(c, ""))) for c in categorical}
    filled = df.select(*[fill[c].alias(c) if c in fill else q(c) for c in df.columns])
    stages, parts = [], []
    if numeric:
        stages.append(VectorAssembler(inputCols=numeric, outputCol="__num", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="__num", outputCol="__num_s", withMean=True, withStd=True))
        parts.append("__num_s")
    if categorical:
        idx = [f"__i_{i}" for i in range(len(categorical))]
        oh = [f"__o_{i}" for i in range(len(categorical))]
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=False, handleInvalid="keep"))
        parts += oh
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return filled, stages


# ---------------------------------------------------------------- metrics
def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> dict[str, DataFrame]:
    """Accuracy, macro F1, per-class precision / recall / F1 / support,
    macro and weighted averages; a zero division counts as 0. Everything is
    derived from the confusion counts (at most classes^2 rows)."""
    conf = pred.groupBy(q(label).alias("y"), q(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = conf.filter(F.col("y") == F.col("p")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = (sup.join(prd, "cls", "full").join(tp, "cls", "left")
           .select("cls", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["support", "predicted", "tp"]]))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f1)
    summ = per.agg(
        F.sum("tp").alias("correct"), F.sum("support").alias("n"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("weighted_precision"),
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("weighted_recall"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    summ = summ.select(F.try_divide(F.col("correct"), F.col("n")).alias("accuracy"), "*").drop("correct")
    return {"per_class": per.select("cls", "precision", "recall", "f1", "support"), "summary": summ}


def confusion_matrix(pred: DataFrame, classes: list, label: str = "label", prediction: str = "prediction",
                     max_classes: int | None = None) -> DataFrame:
    """Dense (true, predicted, count) with zeros; empty past ``max_classes``."""
    spark = pred.sparkSession
    if max_classes is not None and len(classes) > max_classes:
        return spark.createDataFrame([], "true_class string, predicted_class string, count long")
    conf = pred.groupBy(q(label).cast("string").alias("true_class"),
                        q(prediction).cast("string").alias("predicted_class")).agg(F.count(F.lit(1)).alias("n"))
    cl = F.array(*[F.lit(str(c)) for c in classes])
    grid = spark.range(1).select(F.explode(cl).alias("true_class")).select(
        "true_class", F.explode(cl).alias("predicted_class"))
    return (grid.join(F.broadcast(conf), ["true_class", "predicted_class"], "left")
            .select("true_class", "predicted_class", F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R^2, RMSE, MAE (4 dp) from one aggregate."""
    y, p = q(label).cast("double"), q(prediction).cast("double")
    s = pred.agg(F.count(y).alias("n"), F.avg(y).alias("my"), F.sum((y - p) ** 2).alias("sse"),
                 F.sum(F.abs(y - p)).alias("sae"), F.var_pop(y).alias("vy"))
    return s.select(rnd(1 - F.try_divide(F.col("sse"), F.col("vy") * F.col("n")), 4).alias("r2"),
                    rnd(F.sqrt(F.col("sse") / F.col("n")), 4).alias("rmse"),
                    rnd(F.col("sae") / F.col("n"), 4).alias("mae"))


def fold_scores(pred: DataFrame, fold: str = "fold", label: str = "label",
                prediction: str = "prediction", model: str | None = None) -> DataFrame:
    """Macro F1 per fold (and model): confusion counts per (fold, class) only."""
    keys = ([model] if model else []) + [fold]
    conf = pred.groupBy(*[q(k) for k in keys], q(label).alias("y"), q(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    tp = conf.filter(F.col("y") == F.col("p")).groupBy(*keys, F.col("y").alias("cls")).agg(F.sum("n").alias("tp"))
    sup = conf.groupBy(*keys, F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy(*keys, F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = sup.join(prd, keys + ["cls"], "full").join(tp, keys + ["cls"], "left").fillna(0, ["support", "predicted", "tp"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return per.groupBy(*keys).agg(F.avg(f1).alias("score"))


def cv_summary(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Mean, population std and stability = max(0, 1 - std) x 100 (1 dp)."""
    s = scores.groupBy(q(model)).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))
    return s.withColumn("stability", rnd(F.greatest(F.lit(0.0), 1 - F.col("cv_std")) * 100, 1))


def rank_models(summary: DataFrame, order: dict[str, int], model: str = "model") -> DataFrame:
    """One row per model (failed models kept with NULL scores); best = the
    highest CV mean, the earlier model on ties."""
    pos = F.create_map(*[x for m, i in order.items() for x in (F.lit(m), F.lit(i))])
    ranked = summary.withColumn("position", pos[q(model)])
    w = Window.orderBy(F.col("cv_mean").desc_nulls_last(), "position")  # one row per model
    return ranked.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)


# ---------------------------------------------------------------- models
def classifiers(n_train: int, n_classes: int, weight: str | None = "weight") -> list[tuple[str, object]]:
    """Logistic (C = 1 -> regParam = 1/n), tree (depth 10), forest (150,
    sqrt), boosting (80 rounds, step 0.1, depth 4; one-vs-rest past 2 classes) and the
    neighbour vote (k = min(5, n // 10 or 1))."""
    reg = 1.0 / max(1, n_train)
    kw = {"weightCol": weight} if weight else {}
    gbt = GBTClassifier(maxIter=80, stepSize=0.1, maxDepth=4, seed=42)
    return [
        ("Logistic Regression", LogisticRegression(maxIter=500, regParam=reg, elasticNetParam=0.0, **kw)),
        ("Decision Tree", DecisionTreeClassifier(maxDepth=10, seed=42, **kw)),
        ("Random Forest", RandomForestClassifier(numTrees=150, featureSubsetStrategy="sqrt", seed=42, **kw)),
        ("Gradient Boosting", gbt if n_classes <= 2 else OneVsRest(classifier=gbt)),
        ("K-Nearest Neighbors", Neighbours(min(5, n_train // 10 or 1))),
    ]


class Neighbours:
    """The neighbour vote with the ``fit`` / ``transform`` shape of the other candidates,
    over rows with ``__row`` (a unique long), ``features`` and an integer-valued ``label``."""

    def __init__(self, k: int, train: DataFrame | None = None):
        self.k, self.train = k, train

    def fit(self, train: DataFrame) -> "Neighbours":
        return Neighbours(self.k, self._vectors(train))

    @staticmethod
    def _vectors(rows: DataFrame) -> DataFrame:
        return rows.select("__row", "label", vector_to_array("features").alias("v"))

    def transform(self, rows: DataFrame) -> DataFrame:
        votes = knn_vote(self.train, self._vectors(rows), "v", "label", "__row", k=self.k)
        return rows.join(votes.select("__row", F.col("prediction").cast("double").alias("prediction")), "__row")


def regressors(n_train: int) -> list[tuple[str, object]]:
    """Ridge (alpha 1 -> regParam 1/n, no standardisation), tree, forest, boosting."""
    return [
        ("Ridge Regression", LinearRegression(regParam=1.0 / max(1, n_train), elasticNetParam=0.0,
                                              standardization=False)),
        ("Decision Tree", DecisionTreeRegressor(maxDepth=10, seed=42)),
        ("Random Forest", RandomForestRegressor(numTrees=150, seed=42)),
        ("Gradient Boosting", GBTRegressor(maxIter=80, stepSize=0.1, maxDepth=4, seed=42)),
    ]


def feature_importance(model, names: list[str], n: int | None = None) -> list[tuple[str, float]]:
    """Tree importances (their mean over the classes of a one-vs-rest model) or
    mean |coefficient|; > 0 only, 6 dp, the top ``n``."""
    if hasattr(model, "models"):
        imp = sum(m.featureImportances.toArray() for m in model.models) / len(model.models)
    elif hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        imp = abs(m).mean(axis=0)
    elif hasattr(model, "coefficients"):
        imp = abs(model.coefficients.toArray())
    else:
        return []
    order = sorted(range(len(imp)), key=lambda i: -imp[i])[:n]
    return [(names[i] if i < len(names) else str(i), round(float(imp[i]), 6)) for i in order if imp[i] > 0]


def _vector_names(df: DataFrame, col: str) -> list[str]:
    meta = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    out = {}
    for group in meta.values():
        for a in group:
            out[a["idx"]] = a["name"]
    return [out.get(i, str(i)) for i in range(len(out))]


def tournament(df: DataFrame, target: str | None, key: list[str], task: str | None = None,
               primary_keys: list[str] | None = None, seed: int = 42, parallelism: int = 8) -> dict:
    """L6 / L8 end to end (on the target of T10 where none is named): features, stratified split and folds, preprocessing fitted on
    each fold's own training rows, CV score per model (macro F1 or R^2), test metrics,
    ranking, warnings and the best model's importances. Returns DataFrames plus the fitted
    best model.

    The split and folds are stratified when every class has two rows or more. A
    regression drops rows without a numeric target and needs 20 rows. Every model learns from
    all training rows, whatever their number. Every fold's encoded frame is written to the checkpoint folder, as every model reads it."""
    if target is None:
        from ..plans.roles import auto_select_target
        found = auto_select_target(df, primary_keys=primary_keys).collect()
        if not found:
            raise ValueError("no column qualifies as a target")
        target = found[0]["column"]
    if task is None:
        from ..plans.roles import detect_task_type
        task = detect_task_type(df.filter(q(target).isNotNull()), target).collect()[0]["task"]
    classify = task == "classification"
    if not classify:
        df = df.filter(numeric_value(target, df.schema[target].dataType).isNotNull())
    data, numeric, categorical = prepare_features(df, target, primary_keys)
    keyed = df.filter(q(target).isNotNull()).select(*[q(c) for c in dict.fromkeys(key + data.columns)])
    spark = df.sparkSession
    if classify:
        rows, classes = encode_label(keyed, target)
        if len(classes) < 2 or len(classes) > 50:
            raise ValueError("classification needs 2..50 classes")
        per_class = [r["count"] for r in rows.groupBy("label").count().collect()]  # <= 50 rows
        k = min(5, min(per_class)) if min(per_class) >= 2 else 3
        stratify = "label" if min(per_class) >= 2 else None
    else:
        rows = keyed.withColumn("label", numeric_value(target, keyed.schema[target].dataType))
        if rows.count() < 20:
            raise ValueError("Not enough rows for regression analysis.")
        k, stratify, classes = 5, None, []
    rows = split_and_folds(rows, stratify, key, k, 0.2, seed, row="__row")
    n_train = rows.filter(~F.col("is_test")).count()
    models = classifiers(n_train, len(classes)) if classify else regressors(n_train)
    keep = ["__row", "label", "fold", "is_test", "features"] + (["weight"] if classify else [])
    ev = None if classify else RegressionEvaluator(metricName="r2", labelCol="label")

    def encode(fold: int | None) -> DataFrame:
        """All rows (the training rows, for a fold), encoded by what the learning rows say."""
        own = rows if fold is None else rows.filter(~F.col("is_test"))
        learns = ~F.col("is_test") if fold is None else F.col("fold") != fold
        filled, stages = impute_scale_encode(own, numeric, categorical, fit_on=own.filter(learns))
        if classify:
            filled = class_weights(filled, "label", fit_on=own.filter(learns))
        prep = Pipeline(stages=stages).fit(filled.filter(learns))
        return cut_lineage(prep.transform(filled).select(*keep)).withColumn("__learns", learns)

    def run(job):
        name, est, fold = job
        try:
            model = est.fit(encoded[fold].filter("__learns"))
            judged = model.transform(encoded[fold].filter("not __learns"))
            if fold is None:
                return model, judged
            return _macro_f1(judged) if classify else ev.evaluate(judged)
        except Exception as e:  # noqa: BLE001 - a failed model is reported, not fatal
            if _CLUSTER_FAULT.search(str(e)):                     # says nothing about the model
                raise
            return e

    # every encoding and every (model, fold) fit is an independent Spark job graph: submit
    # them from a thread pool, as CrossValidator(parallelism=...) does; the later models take
    # longer and go first, so that their rounds do not run on by themselves at the end
    folds = [*range(k), None]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        encoded = dict(zip(folds, pool.map(encode, folds)))
        jobs = [(name, est, f) for name, est in reversed(models) for f in folds]
        results = dict(zip([(name, f) for name, _, f in jobs], pool.map(run, jobs)))
    names = ["accuracy", "f1_macro"] if classify else ["r2", "rmse", "mae"]
    table, fitted = [], {}
    for name, _ in models:
        got = [results[(name, f)] for f in folds]
        err = next((g for g in got if isinstance(g, Exception)), None)
        if err is not None:
            table.append((name, *[None] * len(names), None, None, str(err)[:200]))
            continue
        fitted[name] = got[-1]
        judged = got[-1][1]
        if classify:
            met = classification_metrics(judged)["summary"].collect()[0]
            own = [round(float(met[c] or 0.0), 4) for c in ("accuracy", "macro_f1")]
        else:
            met = regression_metrics(judged).collect()[0]
            own = [met[c] for c in names]
        table.append((name, *own, *_mean_std(got[:-1]), None))
    schema = ", ".join(f"{c} double" for c in [*names, "cv_mean", "cv_std"])
    res = spark.createDataFrame(table, f"model string, {schema}, error string")
    res = res.withColumn("stability", rnd(F.greatest(F.lit(0.0), 1 - F.col("cv_std")) * 100, 1))
    ranked = rank_models(res, {n: i for i, (n, _) in enumerate(models)})
    ranked = ranked.withColumn("is_best", F.col("is_best") & F.col("cv_mean").isNotNull())
    for c in ("cv_mean", "cv_std"):
        ranked = ranked.withColumn(c, rnd(F.col(c), 4))
    out = {"models": ranked, "task": task, "folds": k, "warnings": training_warnings(rows, "label", task)}
    best_row = ranked.filter("is_best").collect()
    if best_row:
        best, judged = fitted[best_row[0]["model"]]
        out["best"] = best
        if classify:
            out["metrics"] = classification_metrics(judged)
            out["confusion"] = confusion_matrix(judged.withColumn("label", F.col("label").cast("int"))
                                                .withColumn("prediction", F.col("prediction").cast("int")),
                                                list(range(len(classes))), max_classes=25)
        else:
            out["metrics"] = regression_metrics(judged)
        out["importance"] = spark.createDataFrame(
            feature_importance(best, _vector_names(encoded[None], "features"), n=25), "feature string, importance double")
    return out


def _macro_f1(p: DataFrame) -> float:
    r = classification_metrics(p)["summary"].collect()[0]
    return float(r["macro_f1"] or 0.0)


def _mean_std(xs: list[float]) -> tuple[float, float]:
    m = sum(xs) / len(xs)
    return m, math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))


# ---------------------------------------------------------------- neighbours
_HELD = 500_000               # doubles of a step's distances or differences


def _block_top_k(k: int, exclude_self: bool = False):
    """Per (query block, train block) cell: the k nearest train rows of every query
    by squared L2 distance (ties: smaller train key), exactly.

    Distances are first expanded as |q|^2 + |t|^2 - 2 q.t (a matrix product, in
    bounded chunks of queries); every train row within a margin of each query's
    k-th expanded distance is then re-measured exactly as sum((q - t)^2). The
    margin (1e-9 of the norms) is far above the expansion's float64 rounding, so
    the exact re-ranking sees every true neighbour."""
    import numpy as np
    import pandas as pd

    def run(tr: "pd.DataFrame", te: "pd.DataFrame") -> "pd.DataFrame":
        if tr.empty or te.empty:
            return pd.DataFrame({"qk": pd.Series([], dtype="int64"), "tk": pd.Series([], dtype="int64"),
                                 "y": pd.Series([], dtype="int64"), "d": pd.Series([], dtype="float64")})
        tv = np.stack(tr.pop("v").to_numpy()).astype(np.float64, copy=False)
        tk = tr["tk"].to_numpy(np.int64)
        ty = tr["y"].to_numpy(np.int64)
        qv = np.stack(te.pop("v").to_numpy()).astype(np.float64, copy=False)
        qk = te["qk"].to_numpy(np.int64)
        kk = min(k, len(tk))
        tn = np.einsum("td,td->t", tv, tv)
        chunk = max(1, _HELD // len(tk))  # (chunk x train rows) doubles per step
        out = []
        for s in range(0, len(qk), chunk):
            q, qks = qv[s:s + chunk], qk[s:s + chunk]
            qn = np.einsum("qd,qd->q", q, q)
            approx = q @ tv.T
            approx *= -2.0
            approx += qn[:, None] + tn[None, :]
            own = qks[:, None] == tk[None, :] if exclude_self else None
            if exclude_self:  # leave-one-out: a row is not its own neighbour
                approx[own] = np.inf
            kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
            margin = 1e-9 * (qn + tn.max()) + 1e-300
            keep = approx <= (kth + margin)[:, None]
            if exclude_self:
                keep &= ~own
            # ties within the margin may keep a whole block: re-measure in slices of queries
            counts = keep.sum(axis=1)
            part = (np.cumsum(counts) - counts) // max(1, _HELD // max(1, tv.shape[1]))
            for p in np.unique(part):
                mine = np.nonzero(part == p)[0]
                rows, cols = np.nonzero(keep[mine])
                rows = mine[rows]
                diff = q[rows] - tv[cols]
                d = np.einsum("nd,nd->n", diff, diff)
                order = np.lexsort((tk[cols], d, rows))
                rows, cols, d = rows[order], cols[order], d[order]
                first = np.searchsorted(rows, rows, side="left")
                take = (np.arange(len(rows)) - first) < kk
                out.append((qks[rows[take]], tk[cols[take]], ty[cols[take]], d[take]))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("qk", "tk", "y", "d"), zip(*out))})
    return run


def _to_pivots(rows: DataFrame, pivots, name: str = "v"):
    """Each row with its nearest pivot (``cell``) and the distance to it (``r``)."""
    import numpy as np
    import pyarrow as pa
    shared, at = rows.sparkSession.sparkContext.broadcast(pivots), rows.columns.index(name)

    def run(batches):
        p = shared.value
        pn = np.einsum("pd,pd->p", p, p)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                v = np.array(part.column(at).to_pylist(), dtype=np.float64)
                d = np.einsum("nd,nd->n", v, v)[:, None] + pn - 2.0 * (v @ p.T)
                cell = d.argmin(axis=1)
                r = np.sqrt(((v - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(r)], [*part.schema.names, "cell", "r"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{types}, cell int, r double")


def _open_blocks(pivots, cells: list[tuple], blocks: dict[int, list[int]]):
    """mapInArrow step over (qk, v, home, tau): a row for every block besides ``home`` with a
    cell that may hold a row within ``tau`` of the query. In a cell whose rows lie between r0 and r1 from its
    pivot, none is nearer to a query at distance d than d - r1 or r0 - d (triangle inequality)."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        cell, r0, r1 = (np.array(x) for x in zip(*cells))
        p = pivots[cell]
        of = [(block, j) for j, c in enumerate(cell) for block in blocks[int(c)]]
        names = np.array(sorted({b for b, _ in of}))
        pn = np.einsum("pd,pd->p", p, p)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                v = np.array(part.column(1).to_pylist(), dtype=np.float64)
                vn = np.einsum("nd,nd->n", v, v)
                d = np.sqrt(np.maximum(vn[:, None] + pn - 2.0 * (v @ p.T), 0.0))
                slack = 1e-6 * np.sqrt(vn[:, None] + pn)          # far above the rounding of d
                may = np.maximum(d - r1, r0 - d) <= np.asarray(part.column(3))[:, None] + slack
                visit = np.zeros((len(v), len(names)), bool)
                for block, j in of:
                    visit[:, np.searchsorted(names, block)] |= may[:, j]
                visit &= names[None, :] != np.asarray(part.column(2))[:, None]
                q, b = np.nonzero(visit)
                for at in range(0, len(q), 4096):
                    take = pa.array(q[at:at + 4096])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take),
                                                      pa.array(names[b[at:at + 4096]].astype(np.int64))], ["qk", "v", "tb"])
    return run


def nearest_neighbours(train: DataFrame, test: DataFrame, vec: str, label: str, key: str, k: int, block_rows: int = 16384,
                       max_pivots: int = 1024, exclude_self: bool = False) -> tuple[DataFrame, dict]:
    """Exact k nearest train rows of every test row by squared L2 distance (ties: smaller key):
    (qk, tk, y, d), and how many (query, block) visits there were of how many there could be.

    Train rows go to the cell of their nearest pivot (rows of least key hash, their number
    bounded by ``max_pivots``); cells are put together to blocks of about ``block_rows`` rows, and larger cells
    are cut into several. A query first meets the block of its own cell, which
    bounds its k-th distance from above, and then only blocks with a cell that can hold a
    nearer row by the triangle inequality. Blocks meet blocks of queries, so no task holds
    a whole side. On data without structure every block stays open, as for any exact search."""
    import numpy as np
    spark = train.sparkSession
    tr = train.select(F.col(key).cast("long").alias("tk"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("long").alias("y"))
    te = test.select(F.col(key).cast("long").alias("qk"), F.col(vec).cast("array<double>").alias("v"))
    n_train, n_test = tr.count(), te.count()
    qb = max(1, math.ceil(n_test / block_rows))
    pivots = tr.select("v").orderBy(F.xxhash64("tk"), "tk").limit(max(1, min(max_pivots, 8 * math.ceil(n_train / block_rows)))).collect()
    if not pivots:
        return te.select("qk").limit(0).select("qk", F.lit(0).cast("long").alias("tk"), F.lit(0).cast("long").alias("y"),
                                               F.lit(0.0).alias("d")), {"visits": 0, "of": 0}
    p = np.array([r["v"] for r in pivots], dtype=np.float64)
    p = p[np.argsort(p @ np.linalg.svd(p - p.mean(axis=0), full_matrices=False)[2][0])]    # neighbours close to each other
    tr = _to_pivots(tr, p)
    if n_train > block_rows:
        tr = cut_lineage(tr)
    cells = [tuple(r) for r in tr.groupBy("cell").agg(F.min("r"), F.max("r"), F.count(F.lit(1))).orderBy("cell").collect()]
    blocks: dict[int, list[int]] = {}
    last, held = 0, 0
    for cell, _, _, n in cells:                                   # at most max_pivots
        if held and held + n > block_rows:
            last, held = last + 1, 0
        parts = max(1, math.ceil(n / block_rows))
        blocks[cell] = list(range(last, last + parts))
        last, held = (last + parts, 0) if parts > 1 else (last, held + n)
    total = max(b for bs in blocks.values() for b in bs) + 1
    first = F.create_map(*[x for c, bs in blocks.items() for x in (F.lit(c), F.lit(bs[0]))])
    width = F.create_map(*[x for c, bs in blocks.items() for x in (F.lit(c), F.lit(len(bs)))])
    tr = tr.select("tk", "v", "y", (first[F.col("cell")] + F.pmod(F.xxhash64("tk"), width[F.col("cell")])).cast("long").alias("tb"))

    def meet(asked: DataFrame) -> DataFrame:
        spread_tr = tr.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)).cast("array<long>")))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("qk"), F.lit(qb)))
        return spread_tr.groupBy("qb", "tb").cogroup(asked.groupBy("qb", "tb")) \
            .applyInPandas(_block_top_k(k, exclude_self), "qk long, tk long, y long, d double")

    live = sorted(blocks)
    near = F.array(*[F.lit(x) for x in _nearest_live(p, live)])   # cells no row went to have the nearest one that is there
    homes = _to_pivots(te, p).select("qk", "v", first[near[F.col("cell")]].cast("long").alias("tb"))
    if total == 1:
        return meet(homes), {"visits": n_test, "of": n_test}
    homes = cut_lineage(homes)
    found = cut_lineage(meet(homes))
    tau = found.groupBy("qk").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d"))).otherwise(float("inf")).alias("tau"))
    rest = homes.join(tau, "qk", "left").select("qk", "v", F.col("tb").alias("home"), F.coalesce("tau", F.lit(float("inf"))).alias("tau"))
    rest = cut_lineage(rest.mapInArrow(_open_blocks(p, [c[:3] for c in cells], blocks), "qk long, v array<double>, tb long"))
    w = Window.partitionBy("qk").orderBy("d", "tk")               # at most k rows a block and query
    best = found.unionByName(meet(rest)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    return best, {"visits": n_test + rest.count(), "of": n_test * total}


def _nearest_live(p, live: list[int]) -> list[int]:
    import numpy as np
    d = np.einsum("pd,pd->p", p, p)[:, None] + np.einsum("pd,pd->p", p[live], p[live]) - 2.0 * (p @ p[live].T)
    return [live[i] for i in d.argmin(axis=1)]


def knn_vote(train: DataFrame, test: DataFrame, vec: str, label: str, key: str, k: int | None = None,
             block_rows: int = 16384, exclude_self: bool = False) -> DataFrame:
    """Exact k-nearest-neighbour vote (squared L2), k = min(5, n_train // 10 or 1);
    the majority label wins (ties: smaller label).

    The neighbours come from ``nearest_neighbours``: blocks of cells around pivots, of which
    a query visits those that can hold a nearer row. Labels must be integers.
    ``exclude_self`` gives the leave-one-out vote (train = test, a row never votes for itself)."""
    k = k or min(5, train.count() // 10 or 1)
    near, _ = nearest_neighbours(train, test, vec, label, key, k, block_rows, exclude_self=exclude_self)
    queries = test.select(F.col(key).cast("long").alias("qk"))
    votes = near.groupBy("qk", "y").agg(F.count(F.lit(1)).alias("votes"))
    w2 = Window.partitionBy("qk").orderBy(F.desc("votes"), "y")  # <= k rows per query
    best = votes.withColumn("_r", F.row_number().over(w2)).filter("_r = 1")
    return (queries.join(best, "qk", "left")
            .select(F.col("qk").alias(key), F.col("y").alias("prediction"), "votes"))
