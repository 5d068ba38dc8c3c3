"""Image-set statistics (I1-I4) over a DataFrame of file paths (and, when read
through Spark's image source, their sizes). Many image sets can be profiled at
once: every result is grouped by an optional ``dataset`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import q, rnd
from ..functions.values import IMAGE_SUFFIXES

# --- fixed values: augmentation advice rules, in the order they are considered ---
# (technique, reason, priority, code hint); the condition of each rule is in
# ``_conditions`` below, by position.
ADVICE_RULES = [
    ("Horizontal Flip", "Very small dataset — doubles the effective training size cheaply.", "High",
     "transforms.RandomHorizontalFlip(p=0.5)"),
    ("Vertical Flip", "Useful when object orientation varies (e.g., aerial/medical images).", "Medium",
     "transforms.RandomVerticalFlip(p=0.5)"),
    ("Random Rotation (±30°)", "Improves rotational invariance for small datasets.", "High",
     "transforms.RandomRotation(degrees=30)"),
    ("Horizontal Flip", "Standard augmentation for moderate-sized datasets.", "High",
     "transforms.RandomHorizontalFlip(p=0.5)"),
    ("Random Rotation (±15°)", "Adds rotational variance without distortion.", "Medium",
     "transforms.RandomRotation(degrees=15)"),
    ("Oversampling via Augmentation", "Class imbalance ratio is %.1fx — augment minority classes more aggressively.",
     "High", "Use WeightedRandomSampler or apply extra transforms to minority classes."),
    ("Color Jitter (brightness, contrast, saturation)",
     "Improves generalization under different lighting/imaging conditions.", "Medium",
     "transforms.ColorJitter(brightness=0.3, contrast=0.3, saturation=0.3)"),
    ("Random Crop / ResizedCrop", "Forces the model to focus on different regions of the image.", "Medium",
     "transforms.RandomResizedCrop(224, scale=(0.8, 1.0))"),
    ("Gaussian Blur / Noise", "Simulates sensor noise and slight defocus.", "Low",
     "transforms.GaussianBlur(kernel_size=3)"),
    ("Normalization (ImageNet stats)",
     "Standardizes pixel distribution for faster convergence with pretrained models.", "High",
     "transforms.Normalize(mean=[0.485,0.456,0.406], std=[0.229,0.224,0.225])"),
    ("Resize / Center Crop to 224×224 or 256×256", "Images are large (%.0f×%.0fpx). Resize for efficiency.", "High",
     "transforms.Resize(256), transforms.CenterCrop(224)"),
    ("Random Grayscale", "Forces the model to not rely solely on colour cues.", "Low",
     "transforms.RandomGrayscale(p=0.1)"),
]
PRIORITY_ORDER = {"High": 0, "Medium": 1, "Low": 2}


def _ext_ok(path: F.Column) -> F.Column:
    ext = F.lower(F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1)))
    return path.contains(".") & ext.isin(IMAGE_SUFFIXES)


def label_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Keep image files (suffix allow-list) and add ``label``: the parent folder,
    or ``__root__`` for a file at the top."""
    norm = F.regexp_replace(q(path), r"\\", "/")
    parts = F.filter(F.split(norm, "/"), lambda x: x != "")
    return (df.filter(_ext_ok(q(path)))
            .withColumn("label", F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit("__root__"))))


def class_distribution(df: DataFrame, path: str = "path", dataset: str | None = None) -> DataFrame:
    """Images per class label."""
    keys = ([q(dataset)] if dataset else []) + ["label"]
    return label_paths(df, path).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def image_imbalance(df: DataFrame, path: str = "path", dataset: str | None = None) -> DataFrame:
    """Total images, classes and max/min class count (2 dp; 1.0 for one class)."""
    dist = class_distribution(df, path, dataset)
    keys = [q(dataset)] if dataset else []
    s = dist.groupBy(*keys).agg(F.sum("count").alias("total_images"), F.count(F.lit(1)).alias("num_classes"),
                                F.max("count").alias("mx"), F.min("count").alias("mn"))
    ratio = F.when(F.col("num_classes") > 1, rnd(F.col("mx") / F.greatest(F.lit(1), F.col("mn")), 2)).otherwise(1.0)
    return s.select(*keys, F.col("total_images").cast("long").alias("total_images"),
                    F.col("num_classes").cast("long").alias("num_classes"), ratio.alias("class_imbalance_ratio"))


def image_size_stats(images: DataFrame, dataset: str | None = None) -> DataFrame:
    """Average / min / max width and height, average channels and whether
    more than 70 % are single-channel, over every decodable image (the
    reference looked at the first 200 only)."""
    keys = [q(dataset)] if dataset else []
    ok = images.filter(F.col("width").isNotNull())
    return ok.groupBy(*keys).agg(
        rnd(F.avg("width"), 1).alias("avg_width"), rnd(F.avg("height"), 1).alias("avg_height"),
        F.min("width").alias("min_width"), F.max("width").alias("max_width"),
        F.min("height").alias("min_height"), F.max("height").alias("max_height"),
        rnd(F.avg("channels"), 1).alias("avg_channels"),
        (F.sum(F.when(F.col("channels") == 1, 1).otherwise(0)) > F.count(F.lit(1)) * 0.7)
        .alias("is_predominantly_grayscale"))


def _conditions():
    total, ratio = F.col("total_images"), F.col("class_imbalance_ratio")
    w, h = F.coalesce(F.col("avg_width"), F.lit(0.0)), F.coalesce(F.col("avg_height"), F.lit(0.0))
    gray = F.coalesce(F.col("is_predominantly_grayscale"), F.lit(False))
    small, mid = total < 500, (total >= 500) & (total < 2000)
    return [small, small, small, mid, mid, ratio > 3.0, F.lit(True), F.lit(True), F.lit(True), F.lit(True),
            (w > 512) | (h > 512), ~gray]


def augmentation_advice(stats: DataFrame, dataset: str | None = None) -> DataFrame:
    """I4: the rule table applied to each stats row (row-local: the rules are a
    literal array, filtered, de-duplicated by technique keeping the first, and
    ordered High / Medium / Low, stable)."""
    for c, t in [("avg_width", "double"), ("avg_height", "double"), ("is_predominantly_grayscale", "boolean")]:
        if c not in stats.columns:  # path-only statistics carry no sizes
            stats = stats.withColumn(c, F.lit(None).cast(t))
    items = []
    for i, ((tech, reason, prio, hint), cond) in enumerate(zip(ADVICE_RULES, _conditions())):
        if "%.1fx" in reason:
            a, b = reason.split("%.1f")
            text = F.concat(F.lit(a), rnd(F.col("class_imbalance_ratio"), 1).cast("string"), F.lit(b))
        elif "%.0f" in reason:
            a, b, c = reason.split("%.0f")
            text = F.concat(F.lit(a), rnd(F.coalesce(F.col("avg_width"), F.lit(0.0)), 0).cast("long").cast("string"),
                            F.lit(b), rnd(F.coalesce(F.col("avg_height"), F.lit(0.0)), 0).cast("long").cast("string"),
                            F.lit(c))
        else:
            text = F.lit(reason)
        items.append(F.when(cond, F.struct(F.lit(PRIORITY_ORDER[prio]).alias("p"), F.lit(i).alias("i"),
                                           F.lit(tech).alias("technique"), text.alias("reason"),
                                           F.lit(prio).alias("priority"), F.lit(hint).alias("code_hint"))))
    arr = F.filter(F.array(*items), lambda x: x.isNotNull())
    keys = [q(dataset)] if dataset else []
    rows = stats.select(*keys, F.posexplode(arr).alias("_pos", "s")).select(*keys, "s.*")
    # first occurrence of each technique (within a stats row)
    firsts = rows.groupBy(*keys, "technique").agg(F.min("i").alias("i"))
    out = rows.join(firsts, keys + ["technique", "i"])
    return out.select(*keys, "technique", "reason", "priority", "code_hint",
                      F.col("p").alias("priority_rank"), F.col("i").alias("rule"))
