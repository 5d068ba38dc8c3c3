"""Predictive-analysis queries (L1-L16). Metrics, weights, labels, warnings and
ranking are checked against DuckDB on rule-based predictions derived from the
tables, splits, folds and the neighbour vote on the tables themselves; model fitting
(tournaments) is checked by rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import rnd
from ..operators import ml
from ..registry import register, table
from ..sources import derived as dv
from ._sql import rnd as srnd, with_views


def _rule_pred(spark, sf):
    """A rule model on doc_quality: 'long documents are good'."""
    d = dv.doc_quality(spark, sf)
    return d.select("doc_id", F.col("quality").alias("label"),
                    F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction"))


_PRED = with_views("doc_quality") + """,
p AS (SELECT doc_id, quality AS label, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS prediction FROM doc_quality),
conf AS (SELECT label AS y, prediction AS pr, count(*) AS n FROM p GROUP BY 1, 2),
cls AS (SELECT y AS cls FROM conf UNION SELECT pr FROM conf),
per AS (SELECT cls, coalesce((SELECT sum(n) FROM conf WHERE y = cls), 0) AS support,
               coalesce((SELECT sum(n) FROM conf WHERE pr = cls), 0) AS predicted,
               coalesce((SELECT sum(n) FROM conf WHERE y = cls AND pr = cls), 0) AS tp FROM cls),
m AS (SELECT cls, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, tp FROM per),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""

register("classification_per_class_doc_quality", _PRED + f"""
SELECT cls, {srnd('precision')} AS precision, {srnd('recall')} AS recall, {srnd('f1')} AS f1, CAST(support AS BIGINT) AS support FROM m2""")(
    lambda spark, sf: _r(ml.classification_metrics(_rule_pred(spark, sf))["per_class"], ["precision", "recall", "f1"]))
register("classification_summary_doc_quality", _PRED + f"""
SELECT {srnd('sum(tp) / sum(support)')} AS accuracy, CAST(sum(support) AS BIGINT) AS n, {srnd('avg(precision)')} AS macro_precision,
  {srnd('avg(recall)')} AS macro_recall, {srnd('avg(f1)')} AS macro_f1,
  {srnd('sum(precision * support) / sum(support)')} AS weighted_precision,
  {srnd('sum(recall * support) / sum(support)')} AS weighted_recall, {srnd('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM m2""")(
    lambda spark, sf: _r(ml.classification_metrics(_rule_pred(spark, sf))["summary"],
                         ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
                          "weighted_recall", "weighted_f1"]))
register("confusion_matrix_doc_quality", with_views("doc_quality") + """,
p AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS VARCHAR) AS pr FROM doc_quality)
SELECT a.c AS true_class, b.c AS predicted_class, CAST((SELECT count(*) FROM p WHERE t = a.c AND pr = b.c) AS BIGINT) AS count
FROM (VALUES ('0'), ('1')) a(c), (VALUES ('0'), ('1')) b(c)""")(
    lambda spark, sf: ml.confusion_matrix(_rule_pred(spark, sf), [0, 1]))


def _r(df, cols, digits=4):
    return df.select(*[rnd(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


register("regression_metrics_lineitem", f"""SELECT {srnd('1 - sum(pow(l_extendedprice - l_quantity * 1500.0, 2)) / (var_pop(l_extendedprice) * count(*))')} AS r2,
  {srnd('sqrt(sum(pow(l_extendedprice - l_quantity * 1500.0, 2)) / count(*))')} AS rmse,
  {srnd('sum(abs(l_extendedprice - l_quantity * 1500.0)) / count(*)')} AS mae FROM lineitem""")(
    lambda spark, sf: ml.regression_metrics(table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))))


def _rule_folds(spark, sf):
    d = dv.doc_quality(spark, sf)
    parts = []
    for t in (1000, 2000, 5000):
        parts.append(d.select(F.lit(f"len>{t}").alias("model"), (F.col("doc_id") % 5).cast("int").alias("fold"),
                              F.col("quality").alias("label"),
                              F.when(F.col("n_chars") > t, 1).otherwise(0).alias("prediction")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FOLDS = with_views("doc_quality") + """,
p AS (SELECT 'len>' || t AS model, CAST(doc_id % 5 AS INTEGER) AS fold, quality AS label,
             CASE WHEN n_chars > t THEN 1 ELSE 0 END AS prediction
      FROM doc_quality, (VALUES (1000), (2000), (5000)) v(t)),
conf AS (SELECT model, fold, label AS y, prediction AS pr, count(*) AS n FROM p GROUP BY ALL),
cls AS (SELECT model, fold, y AS cls FROM conf UNION SELECT model, fold, pr FROM conf),
per AS (SELECT c.model, c.fold, c.cls,
          coalesce((SELECT sum(n) FROM conf x WHERE x.model = c.model AND x.fold = c.fold AND x.y = c.cls), 0) AS support,
          coalesce((SELECT sum(n) FROM conf x WHERE x.model = c.model AND x.fold = c.fold AND x.pr = c.cls), 0) AS predicted,
          coalesce((SELECT sum(n) FROM conf x WHERE x.model = c.model AND x.fold = c.fold AND x.y = c.cls AND x.pr = c.cls), 0) AS tp
        FROM cls c),
f AS (SELECT model, fold, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr_, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per),
s AS (SELECT model, fold, avg(CASE WHEN pr_ + rc > 0 THEN 2 * pr_ * rc / (pr_ + rc) ELSE 0 END) AS score FROM f GROUP BY 1, 2),
cv AS (SELECT model, avg(score) AS cv_mean, stddev_pop(score) AS cv_std FROM s GROUP BY 1)"""

register("fold_scores_doc_quality", _FOLDS + f"\nSELECT model, fold, {srnd('score')} AS score FROM s")(
    lambda spark, sf: _r(ml.fold_scores(_rule_folds(spark, sf), model="model"), ["score"]))
register("cv_summary_doc_quality", _FOLDS + f"""
SELECT model, {srnd('cv_mean')} AS cv_mean, {srnd('cv_std')} AS cv_std, {srnd('greatest(0.0, 1 - cv_std) * 100', 1)} AS stability FROM cv""")(
    lambda spark, sf: _r(ml.cv_summary(ml.fold_scores(_rule_folds(spark, sf), model="model")), ["cv_mean", "cv_std"]))
register("rank_models_doc_quality", _FOLDS + """
SELECT model, row_number() OVER (ORDER BY cv_mean DESC NULLS LAST, CASE model WHEN 'len>1000' THEN 0 WHEN 'len>2000' THEN 1 ELSE 2 END) AS rank,
  row_number() OVER (ORDER BY cv_mean DESC NULLS LAST, CASE model WHEN 'len>1000' THEN 0 WHEN 'len>2000' THEN 1 ELSE 2 END) = 1 AS is_best FROM cv""")(
    lambda spark, sf: ml.rank_models(ml.cv_summary(ml.fold_scores(_rule_folds(spark, sf), model="model")),
                                     {"len>1000": 0, "len>2000": 1, "len>5000": 2}).select("model", "rank", "is_best"))

register("encode_label_orders_status",
         "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label FROM orders")(
    lambda spark, sf: ml.encode_label(table(spark, sf, "orders"), "o_orderstatus")[0].select("o_orderkey", "label"))
register("class_weights_labels", f"""SELECT doc_id, quality, {srnd('count(*) OVER () / ((SELECT count(DISTINCT quality) FROM labels) * count(*) OVER (PARTITION BY quality))')} AS weight FROM labels""")(
    lambda spark, sf: _r(ml.class_weights(table(spark, sf, "labels"), "quality").select("doc_id", "quality", "weight"), ["weight"]))
register("training_warnings_labels_toxic", """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1),
s AS (SELECT sum(n) AS total, max(n) / sum(n) AS maj, min(n) AS mn FROM c)
SELECT * FROM (
  SELECT 0 AS n, 'Class imbalance detected — consider SMOTE or class_weight=''balanced''.' AS warning FROM s WHERE round(maj, 3) >= 0.8
  UNION ALL SELECT 1, 'Small training sample — metrics may be unstable.' FROM s WHERE total < 200
  UNION ALL SELECT 2, 'Stratified split not possible due to rare classes.' FROM s WHERE mn < 2)""")(
    lambda spark, sf: ml.training_warnings(table(spark, sf, "labels"), "toxic").withColumn("n", F.col("n").cast("int")))


@register("prepare_features_doc_quality")
def _prep(spark, sf):
    data, num, cat = ml.prepare_features(dv.doc_quality(spark, sf), "quality")
    filled, stages = ml.impute_scale_encode(data, num, cat)
    from pyspark.ml import Pipeline
    return Pipeline(stages=stages).fit(filled).transform(filled).select("quality", "features")


_SPLIT = with_views("doc_quality") + """,
r AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (
        PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|split42'), doc_id) - 1 AS place FROM doc_quality),
k AS (SELECT CASE WHEN min(n) >= 2 THEN least(5, min(n)) ELSE 3 END AS k FROM r),
t AS (SELECT *, CAST(floor(n * 0.2::DOUBLE + 0.5) AS BIGINT) AS cut FROM r, k),
s AS (SELECT doc_id, quality, place < cut AS is_test,
             CASE WHEN place >= cut THEN CAST((place - cut) % k AS INTEGER) END AS fold FROM t)"""


def _split_rows(spark, sf):
    d = dv.doc_quality(spark, sf)
    return ml.split_and_folds(d, "quality", ["doc_id"], ml.fold_count(d, "quality"))


register("stratified_split_doc_quality",
         _SPLIT + "\nSELECT quality, is_test, fold, count(*) AS count FROM s GROUP BY ALL")(
    lambda spark, sf: _split_rows(spark, sf).groupBy("quality", "is_test", "fold").count())
register("stratified_rows_doc_quality", _SPLIT + "\nSELECT * FROM s")(
    lambda spark, sf: _split_rows(spark, sf).select("doc_id", "quality", "is_test", "fold"))
register("training_warnings_regression_nation", """SELECT 0 AS n, 'Regression task detected (continuous target).' AS warning
  UNION ALL SELECT 1, 'Small training sample — regression metrics may be unstable.' FROM nation HAVING count(n_regionkey) < 200""")(
    lambda spark, sf: ml.training_warnings(table(spark, sf, "nation"), "n_regionkey", "regression").withColumn("n", F.col("n").cast("int")))
register("training_warnings_regression_orders", """SELECT 0 AS n, 'Regression task detected (continuous target).' AS warning
  UNION ALL SELECT 1, 'Small training sample — regression metrics may be unstable.' FROM orders HAVING count(o_totalprice) < 200""")(
    lambda spark, sf: ml.training_warnings(table(spark, sf, "orders"), "o_totalprice", "regression").withColumn("n", F.col("n").cast("int")))


@register("tournament_classification_doc_quality")
def _tourn(spark, sf):
    return ml.tournament(dv.doc_quality(spark, sf), "quality", ["doc_id"], task="classification")["models"]


@register("tournament_regression_doc_quality")
def _tourn_r(spark, sf):
    return ml.tournament(dv.doc_quality(spark, sf).drop("toxic"), "n_chars", ["doc_id"], task="regression")["models"]


@register("knn_vote_embeddings", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, count(*) OVER (PARTITION BY label) AS n,
        row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || '|split42'), vec_id) - 1 AS place
      FROM embeddings),
s AS (SELECT *, place < floor(n * 0.2::DOUBLE + 0.5) AS is_test FROM e),
p AS (SELECT a.vec_id AS qk, b.vec_id AS tk, b.label AS y,
        list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
      FROM s a, s b WHERE a.is_test AND NOT b.is_test),
r AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY d, tk) AS rn FROM p),
n AS (SELECT qk, y, count(*) AS votes FROM r
      WHERE rn <= (SELECT least(5, greatest(1, count(*) // 10)) FROM s WHERE NOT is_test) GROUP BY qk, y),
b AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY votes DESC, y) AS rn FROM n)
SELECT qk AS vec_id, CAST(y AS BIGINT) AS prediction, CAST(votes AS BIGINT) AS votes FROM b WHERE rn = 1""")
def _knn(spark, sf):
    e = table(spark, sf, "embeddings")
    s = ml.stratified_split(e, "label", ["vec_id"])
    train, test = s.filter(~F.col("is_test")), s.filter(F.col("is_test"))
    return ml.knn_vote(train, test, "embedding", "label", "vec_id")


register("knn_loo_vote_embeddings", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
p AS (SELECT a.vec_id AS qk, b.vec_id AS tk, b.label AS y,
        list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
      FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY d, tk) AS rn FROM p),
n AS (SELECT qk, y, count(*) AS votes FROM r
      WHERE rn <= (SELECT least(5, greatest(1, count(*) // 10)) FROM embeddings) GROUP BY qk, y),
b AS (SELECT *, row_number() OVER (PARTITION BY qk ORDER BY votes DESC, y) AS rn FROM n)
SELECT qk AS vec_id, CAST(y AS BIGINT) AS prediction, CAST(votes AS BIGINT) AS votes FROM b WHERE rn = 1""")(
    lambda spark, sf: ml.knn_vote(table(spark, sf, "embeddings"), table(spark, sf, "embeddings"),
                                  "embedding", "label", "vec_id", exclude_self=True))
