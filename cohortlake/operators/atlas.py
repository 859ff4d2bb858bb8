"""Atlas look-ups: atlas_voxels (atlas, label_idx, i, j, k, prob) and atlas_labels (atlas, idx, name, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.columns import affine, inverse_affine, nearest, valid_coordinate
from cohortlake.operators.sizes import small

IJK = ["i", "j", "k"]
IDENTITY = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0]


def voxel_to_mm(df: DataFrame, m: list[float]) -> DataFrame:
    x, y, z = affine(m, "i", "j", "k")
    return df.withColumns({"x": x, "y": y, "z": z})


def mm_to_voxel(df: DataFrame, m: list[float]) -> DataFrame:
    """Half-up rounded voxel (vi, vj, vk) of (x, y, z)."""
    i, j, k = affine(inverse_affine(m), "x", "y", "z")
    return df.withColumns({"vi": nearest(i), "vj": nearest(j), "vk": nearest(k)})


def coordinate_grid(spark, shape: tuple[int, int, int], m: list[float]) -> DataFrame:
    """mm of every voxel of a grid; one flat range, so tasks share it."""
    n = F.col("id")
    grid = spark.range(shape[0] * shape[1] * shape[2]).select(F.floor(n / (shape[1] * shape[2])).cast("int").alias("i"), (F.floor(n / shape[2]) % shape[1]).cast("int").alias("j"), (n % shape[2]).cast("int").alias("k"))
    return voxel_to_mm(grid, m)


def resample_to_atlas(mask: DataFrame, image: list[float], atlas: list[float]) -> DataFrame:
    """Mask voxels to the atlas voxels that hold their mm place."""
    out = mm_to_voxel(voxel_to_mm(mask, image), atlas)
    return out.select(F.col("vi").alias("i"), F.col("vj").alias("j"), F.col("vk").alias("k"), "value")


def atlas_avg_probability(mask: DataFrame, atlas: DataFrame) -> DataFrame:
    """sum(prob mask) / sum(mask) for each label; the denominator is over the whole mask, 0 gives 0."""
    total = mask.agg(F.sum("value").alias("total"))
    own = atlas.join(small(mask.select(*IJK, "value")), IJK).groupBy("atlas", "label_idx").agg(F.sum(F.col("prob") * F.col("value")).alias("s"))
    labels = atlas.select("atlas", "label_idx").distinct()
    out = labels.join(own, ["atlas", "label_idx"], "left").crossJoin(F.broadcast(total))
    return out.select("atlas", "label_idx", F.when(F.coalesce("total", F.lit(0)) == 0, 0.0).otherwise(F.coalesce(F.col("s") / F.col("total"), F.lit(0.0))).alias("avg_prob"))


def atlas_roi_overlap(mask: DataFrame, atlas: DataFrame) -> DataFrame:
    """sum(prob mask) / sum(prob) for each label: for a label atlas the share of its voxels inside the mask."""
    out = atlas.join(small(mask.select(*IJK, "value")), IJK, "left").groupBy("atlas", "label_idx")
    s = F.sum(F.col("prob") * F.coalesce("value", F.lit(0)))
    return out.agg(F.when(F.sum("prob") == 0, 0.0).otherwise(s / F.sum("prob")).alias("overlap"))


def atlas_query(mask: DataFrame, atlas: DataFrame, labels: DataFrame, stat: str = "avg_prob", precision: int = 4, binary: bool = False) -> DataFrame:
    """(atlas, label_idx, name, value): all labels with a value above 0."""
    m = mask.withColumn("value", F.when(F.col("value") > 0, 1.0).otherwise(0.0)) if binary else mask
    out = (atlas_avg_probability if stat == "avg_prob" else atlas_roi_overlap)(m, atlas)
    return label_lookup(out, labels).select("atlas", "label_idx", "name", F.round(stat, precision).alias("value")).filter(F.col("value") > 0)


def label_lookup(df: DataFrame, labels: DataFrame) -> DataFrame:
    """``name`` of each label_idx, 'Unknown' where it has none."""
    names = small(labels.select("atlas", F.col("idx").alias("label_idx"), "name"))
    return df.join(names, ["atlas", "label_idx"], "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))


def label_centres(labels: DataFrame) -> DataFrame:
    return labels.select("atlas", "idx", "x", "y", "z")


def point_probability(points: DataFrame, atlas: DataFrame, m: list[float], shape: tuple[int, int, int]) -> DataFrame:
    """points (point_id, label_idx, x, y, z) with ``prob``, 0 outside the grid or the structure."""
    p = mm_to_voxel(points, m)
    a = atlas.select("label_idx", F.col("i").alias("vi"), F.col("j").alias("vj"), F.col("k").alias("vk"), "prob")
    out = p.join(a, ["label_idx", "vi", "vj", "vk"], "left")
    inside = valid_coordinate("vi", "vj", "vk", shape)
    return out.withColumn("prob", F.when(inside, F.coalesce("prob", F.lit(0.0))).otherwise(0.0)).select("point_id", "label_idx", "prob")


def point_description(points: DataFrame, atlas: DataFrame, labels: DataFrame, m: list[float], precision: int = 2) -> DataFrame:
    """(point_id, description): 'prob% name' of all labels there, largest first, or 'No label found.'"""
    p = mm_to_voxel(points, m)
    a = label_lookup(atlas, labels).select(F.col("i").alias("vi"), F.col("j").alias("vj"), F.col("k").alias("vk"), "name", F.round("prob", precision).alias("prob")).filter("prob <> 0")
    out = p.join(a, ["vi", "vj", "vk"], "left").groupBy("point_id").agg(F.array_sort(F.collect_list(F.when(F.col("prob").isNotNull(), F.struct((-F.col("prob")).alias("o"), "name", "prob")))).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat(F.format_string(f"%.{precision}f%% ", x["prob"]), x["name"])), ", ")
    return out.select("point_id", F.when(F.size("f") == 0, "No label found.").otherwise(text).alias("description"))
