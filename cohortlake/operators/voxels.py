"""Masks, regions and shapes over voxel tables (volume_id, i, j, k, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.operators.sizes import small

IJK = ["i", "j", "k"]


def apply_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels where the mask is above 0."""
    return voxels.join(small(mask.filter("value > 0").select(*IJK).distinct()), IJK, "left_semi")


def attach_roi_index(voxels: DataFrame, rois: DataFrame) -> DataFrame:
    """``voxels`` with their ``roi``; null outside."""
    return voxels.join(small(rois.select(*IJK, "roi")), IJK, "left")


def roi_list(rois: DataFrame, column: str = "roi") -> DataFrame:
    return rois.select(column).filter(F.col(column) != 0).distinct().orderBy(column)


def roi_centres(rois: DataFrame) -> DataFrame:
    return rois.filter("roi <> 0").groupBy("roi").agg(*[F.avg(c).alias(c) for c in IJK])


def union_mask(masks: DataFrame) -> DataFrame:
    """One mask of all volumes: 1 where their sum is above 0."""
    return masks.groupBy(*IJK).agg(F.sum("value").alias("s")).filter("s > 0").select(*IJK, F.lit(1).alias("value"))


def partition_by_roi(series: DataFrame, rois: DataFrame, length: int, mask: DataFrame | None = None, order: list[int] | None = None) -> DataFrame:
    """Series (volume_id, i, j, k, ts) with their region, without those of sum 0.

    A volume's region without any series has one of ``length`` zeros. With ``order`` only its regions, in that place
    (column ``place``).
    """
    rows = apply_mask(series, mask) if mask is not None else series
    regions = roi_list(rois)
    if order is not None:
        spark = series.sparkSession
        regions = spark.createDataFrame([(p, r) for p, r in enumerate(order)], "place int, roi int")
    inside = rows.join(small(rois.filter("roi <> 0").select(*IJK, "roi")), IJK).filter(F.aggregate("ts", F.lit(0.0), lambda a, x: a + x) != 0)
    wanted = series.select("volume_id").distinct().crossJoin(small(regions, 100_000))
    out = wanted.join(inside.select("volume_id", "roi", *IJK, "ts"), ["volume_id", "roi"], "left")
    return out.withColumn("ts", F.coalesce("ts", F.array_repeat(F.lit(0.0), length)))


def drain_rois(rois: DataFrame, flat: bool = False) -> DataFrame:
    """Border voxels: those whose 3 x 3 x 3 (flat: 3 x 3) neighbourhood is not all of their region."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in ((0,) if flat else (-1, 0, 1))]
    rows = rois.filter("roi <> 0").select(*IJK, "roi")
    offsets = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("abc", s, strict=True)]) for s in steps])).alias("d")
    seen = rows.select("*", offsets).select((F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"), (F.col("k") + F.col("d.c")).alias("k"), "roi")
    inner = seen.groupBy(*IJK, "roi").count().filter(F.col("count") == len(steps)).select(*IJK, "roi")
    return rows.join(inner, [*IJK, "roi"], "left_anti")


def shape_check(shapes: DataFrame, reference: str, dims: int | None = None) -> DataFrame:
    """Images (image_id, shape) whose shape, or its first ``dims``, differs from the reference image's."""
    cut = (lambda c: F.slice(c, 1, dims)) if dims else (lambda c: c)
    ref = shapes.filter(F.col("image_id") == reference).select(F.col("shape").alias("ref"))
    return shapes.crossJoin(F.broadcast(ref.limit(1))).filter(cut(F.col("shape")) != cut(F.col("ref"))).select("image_id", "shape", "ref")


def keep_selected(features: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Features (fold, feature_id, ...) with a weight above 0 in both selections."""
    on = ["fold", "feature_id"]
    for sel in (train, test):
        features = features.join(sel.filter("weight > 0").select(*on).distinct(), on, "left_semi")
    return features


def skip_done(configs: DataFrame, results: DataFrame, key: str = "config_id") -> DataFrame:
    return configs.join(results.select(key).distinct(), key, "left_anti")


def param_grid(lists: list[DataFrame]) -> DataFrame:
    """All combinations of the rows of small parameter tables."""
    return reduce(lambda a, b: a.crossJoin(small(b, 100_000)), lists)


def volume_matrix(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """One row per volume: its values at all flat indexes (0 where absent)."""
    import numpy as np
    import pyarrow as pa

    n = shape[0] * shape[1] * shape[2]
    at = ((F.col("i") * shape[1] + F.col("j")) * shape[2] + F.col("k")).alias("at")
    whole = voxels.groupBy("volume_id").agg(F.collect_list(F.struct(at, F.col("value").cast("double").alias("value"))).alias("cells"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                cells = b.column(1)[r].values
                row = np.zeros(n)
                row[cells.field("at").to_numpy()] = cells.field("value").to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(r, 1), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(row))], names=["volume_id", "row"])

    return whole.mapInArrow(run, f"volume_id {voxels.schema['volume_id'].dataType.simpleString()}, row array<double>")
