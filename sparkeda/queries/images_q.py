"""Image-set queries (I1, I2, I4) over path strings derived from documents."""

from __future__ import annotations

from ..operators import images as im
from ..registry import register
from ..sources import derived as dv
from ..sources.io import image_headers
from ._sql import rnd as srnd, with_views

_LABEL = with_views("doc_paths") + """,
lp AS (SELECT path, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '') AS parts FROM doc_paths
       WHERE contains(path, '.') AND lower('.' || string_split(path, '.')[-1]) IN ('.jpg', '.jpeg', '.png', '.bmp', '.gif', '.tiff', '.webp')),
lab AS (SELECT CASE WHEN len(parts) >= 2 THEN parts[-2] ELSE '__root__' END AS label FROM lp),
dist AS (SELECT label, CAST(count(*) AS BIGINT) AS count FROM lab GROUP BY 1),
imb AS (SELECT CAST(sum(count) AS BIGINT) AS total_images, CAST(count(*) AS BIGINT) AS num_classes,
               CASE WHEN count(*) > 1 THEN """ + srnd("max(count) / greatest(1, min(count))", 2) + """ ELSE 1.0 END AS class_imbalance_ratio FROM dist)"""

register("class_distribution_doc_paths", _LABEL + "\nSELECT label, count FROM dist")(
    lambda spark, sf: im.class_distribution(dv.doc_paths(spark, sf)))
register("image_imbalance_doc_paths", _LABEL + "\nSELECT * FROM imb")(
    lambda spark, sf: im.image_imbalance(dv.doc_paths(spark, sf)))


def _rules_sql():
    conds = ["total_images < 500", "total_images < 500", "total_images < 500",
             "total_images >= 500 AND total_images < 2000", "total_images >= 500 AND total_images < 2000",
             "class_imbalance_ratio > 3.0", "true", "true", "true", "true", "false", "true"]
    rows = []
    for i, ((tech, reason, prio, hint), cond) in enumerate(zip(im.ADVICE_RULES, conds)):
        if "%.1fx" in reason:
            a, b = reason.split("%.1f")
            txt = f"'{a}' || CAST({srnd('class_imbalance_ratio', 1)} AS VARCHAR) || '{b}'"
        elif "%.0f" in reason:
            a, b, c = reason.split("%.0f")
            txt = f"'{a}0{b}0{c}'"
        else:
            txt = "'" + reason.replace("'", "''") + "'"
        rows.append(f"SELECT {i} AS rule, '{tech}' AS technique, {txt} AS reason, '{prio}' AS priority, "
                    f"'{hint}' AS code_hint, {im.PRIORITY_ORDER[prio]} AS priority_rank FROM imb WHERE {cond}")
    return "\nUNION ALL\n".join(rows)


register("augmentation_advice_doc_paths", _LABEL + f""",
cand AS ({_rules_sql()})
SELECT technique, reason, priority, code_hint, priority_rank, rule FROM cand
WHERE rule = (SELECT min(rule) FROM cand c2 WHERE c2.technique = cand.technique)""")(
    lambda spark, sf: im.augmentation_advice(im.image_imbalance(dv.doc_paths(spark, sf))))

_SIZES = """s AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(vec_id % 700 + 16 AS INTEGER) AS width,
       CAST(vec_id % 500 + 9 AS INTEGER) AS height, CASE vec_id % 4 WHEN 1 THEN 1 ELSE 3 END AS channels FROM embeddings)"""
register("image_headers_embeddings", f"WITH {_SIZES}\nSELECT * FROM s")(
    lambda spark, sf: image_headers(dv.image_bytes(spark, sf)).drop("content"))
register("image_size_stats_embeddings", f"""WITH {_SIZES}
SELECT label, {srnd("avg(width)", 1)} AS avg_width, {srnd("avg(height)", 1)} AS avg_height, min(width) AS min_width, max(width) AS max_width,
  min(height) AS min_height, max(height) AS max_height, {srnd("avg(channels)", 1)} AS avg_channels,
  count(CASE WHEN channels = 1 THEN 1 END) > count(*) * 0.7 AS is_predominantly_grayscale FROM s GROUP BY label""")(
    lambda spark, sf: im.image_size_stats(image_headers(dv.image_bytes(spark, sf)), "label"))
