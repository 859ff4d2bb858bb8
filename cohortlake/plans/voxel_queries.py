"""Queries of masks, regions and atlases."""

from pyspark.sql import functions as F

from cohortlake.functions.columns import binarise, flat_index, threshold, valid_coordinate
from cohortlake.operators import atlas as A
from cohortlake.operators import voxels as V
from cohortlake.plans import data as D
from cohortlake.plans.base import query, table

AFF = [2.0, 0.0, 0.0, -10.0, 0.0, 2.0, 0.0, 4.0, 0.0, 0.0, 3.0, 0.0]
ATL = [2.0, 0.0, 0.0, -8.0, 0.0, 2.0, 0.0, 4.0, 0.0, 0.0, 3.0, -3.0]


@query("binarise", f"WITH {D.VOX} SELECT volume_id, i, j, k, (value BETWEEN 20 AND 60)::INT AS flag FROM vox")
def q_binarise(spark, sf):
    return D.vox(spark, sf).select("volume_id", "i", "j", "k", binarise("value", 20, 60).alias("flag"))


@query("threshold", f"WITH {D.VOX} SELECT volume_id, i, j, k, value * (value > 20 AND value < 60)::INT AS value FROM vox")
def q_threshold(spark, sf):
    return D.vox(spark, sf).select("volume_id", "i", "j", "k", threshold("value", 20, 60, inclusive=False).alias("value"))


@query("valid_coordinate", f'WITH {D.VOX} SELECT volume_id, i, j, k, (i < 16 AND j < 16 AND k < 4) AS valid, ((i * 16 + j) * 8 + k)::INT AS "at" FROM vox')
def q_valid(spark, sf):
    return D.vox(spark, sf).select("volume_id", "i", "j", "k", valid_coordinate("i", "j", "k", (16, 16, 4)).alias("valid"), flat_index("i", "j", "k", (32, 16, 8)).cast("int").alias("at"))


@query("apply_mask", f"WITH {D.VOX}, {D.MASK} SELECT volume_id, i, j, k, value FROM vox WHERE (i, j, k) IN (SELECT (i, j, k) FROM mask)")
def q_mask(spark, sf):
    return V.apply_mask(D.vox(spark, sf), D.mask(spark, sf)).select("volume_id", "i", "j", "k", "value")


@query("attach_roi_index", f"WITH {D.VOX}, {D.ROIS} SELECT volume_id, i, j, k, value, roi FROM vox LEFT JOIN rois USING (i, j, k)")
def q_attach(spark, sf):
    return V.attach_roi_index(D.vox(spark, sf), D.rois(spark, sf)).select("volume_id", "i", "j", "k", "value", "roi")


@query("roi_list", f"WITH {D.VOX}, {D.ROIS} SELECT DISTINCT roi FROM rois WHERE roi <> 0")
def q_roi_list(spark, sf):
    return V.roi_list(D.rois(spark, sf))


@query("roi_centres", f"WITH {D.VOX}, {D.ROIS} SELECT roi, round(avg(i), 6) AS i, round(avg(j), 6) AS j, round(avg(k), 6) AS k FROM rois WHERE roi <> 0 GROUP BY roi")
def q_centres(spark, sf):
    return V.roi_centres(D.rois(spark, sf)).select("roi", *[F.round(c, 6).alias(c) for c in "ijk"])


@query("union_mask", f"WITH {D.VOX} SELECT i, j, k, 1 AS value FROM vox GROUP BY i, j, k HAVING sum(value) > 0")
def q_union(spark, sf):
    return V.union_mask(D.vox(spark, sf))


@query("partition_by_roi", """
WITH s AS (SELECT label AS roi, vec_id, embedding::DOUBLE[] AS ts FROM embeddings),
 kept AS (SELECT roi, vec_id, list_sum(ts) AS total FROM s WHERE roi <> 0 AND list_sum(ts) <> 0),
 lst AS (SELECT 3 AS roi, 0 AS place UNION ALL SELECT 1, 1 UNION ALL SELECT 99, 2)
SELECT lst.roi, vec_id, 64 AS n, round(coalesce(total, 0), 5) + 0.0 AS total FROM lst LEFT JOIN kept USING (roi)""")
def q_partition(spark, sf):
    e = table(spark, sf, "embeddings").select(F.lit("v").alias("volume_id"), F.col("vec_id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("k"), F.col("embedding").cast("array<double>").alias("ts"), F.col("label").alias("roi"), "vec_id")
    out = V.partition_by_roi(e.drop("roi"), e.select("i", "j", "k", "roi"), 64, order=[3, 1, 99])
    total = F.aggregate("ts", F.lit(0.0), lambda a, x: a + x)
    return out.select("roi", F.col("i").cast("long").alias("vec_id"), F.size("ts").alias("n"), (F.round(total, 5) + 0.0).alias("total"))


@query("nonzero_series", "SELECT vec_id FROM embeddings WHERE list_sum(embedding::DOUBLE[]) <> 0")
def q_nonzero(spark, sf):
    from cohortlake.functions.columns import nonzero

    return table(spark, sf, "embeddings").filter(nonzero(F.col("embedding").cast("array<double>"))).select("vec_id")


_OFF = "off AS (SELECT a, b, c FROM range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c))"


@query("drain_rois", f"""WITH {D.VOX}, {D.ROIS}, {_OFF}, r AS (SELECT * FROM rois WHERE roi <> 0),
 inside AS (SELECT i, j, k, roi FROM (SELECT i + a AS i, j + b AS j, k + c AS k, roi FROM r, off) GROUP BY 1, 2, 3, 4 HAVING count(*) = 27)
SELECT i, j, k, roi FROM r ANTI JOIN inside USING (i, j, k, roi)""")
def q_drain(spark, sf):
    return V.drain_rois(D.rois(spark, sf)).select("i", "j", "k", "roi")


@query("shape_check", "WITH s AS (SELECT l_orderkey::VARCHAR AS image_id, [max(l_linenumber), count(DISTINCT l_returnflag)::INT] AS shape FROM lineitem GROUP BY l_orderkey) SELECT image_id, shape FROM s WHERE image_id <> '1' AND shape <> (SELECT shape FROM s WHERE image_id = '1')")
def q_shape(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("a"), F.count_distinct("l_returnflag").cast("int").alias("b"))
    return V.shape_check(n.select(F.col("l_orderkey").cast("string").alias("image_id"), F.array("a", "b").alias("shape")), "1").select("image_id", "shape")


@query("keep_selected", f"WITH {D.SEL} SELECT DISTINCT fold, feature_id FROM sel a WHERE config_id IN ('p0', 'p2', 'p4') AND weight > 0 AND EXISTS (SELECT 1 FROM sel b WHERE b.config_id IN ('p1', 'p3', 'p5') AND b.fold = a.fold AND b.feature_id = a.feature_id AND b.weight > 0)")
def q_keep(spark, sf):
    s = D.selections(spark, sf)
    first = F.col("config_id").isin("p0", "p2", "p4")
    return V.keep_selected(s.select("fold", "feature_id").distinct(), s.filter(first), s.filter(~first))


@query("skip_done", "SELECT c_custkey AS config_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_skip(spark, sf):
    return V.skip_done(table(spark, sf, "customer").select(F.col("c_custkey").alias("config_id")), table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("config_id")))


@query("param_grid", "SELECT r_name AS a, b, c FROM region, (SELECT DISTINCT o_orderpriority AS b FROM orders), (SELECT DISTINCT l_returnflag AS c FROM lineitem)")
def q_grid(spark, sf):
    return V.param_grid([table(spark, sf, "region").select(F.col("r_name").alias("a")), table(spark, sf, "orders").select(F.col("o_orderpriority").alias("b")).distinct(), table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("c")).distinct()])


@query("volume_matrix", f"""WITH {D.VOX}, c AS (SELECT volume_id, pos, coalesce(value, 0) AS value FROM (SELECT volume_id, pos FROM (SELECT DISTINCT volume_id FROM vox), range(0, 8192) r(pos)) LEFT JOIN (SELECT volume_id, (i * 32 + j) * 8 + k AS pos, value FROM vox) USING (volume_id, pos)) SELECT volume_id, list(value ORDER BY pos) AS "row" FROM c GROUP BY volume_id""")
def q_matrix(spark, sf):
    return V.volume_matrix(D.vox(spark, sf), (32, 32, 8))


@query("voxel_to_mm", f"WITH {D.VOX} SELECT DISTINCT i, j, k, 2.0::DOUBLE * i - 10 AS x, 2.0::DOUBLE * j + 4 AS y, 3.0::DOUBLE * k AS z FROM vox")
def q_mm(spark, sf):
    return A.voxel_to_mm(D.cells(spark, sf), AFF)


@query("mm_to_voxel", f"WITH {D.VOX} SELECT DISTINCT i, j, k, floor((i * 1.0 + 10) / 2 + 0.5)::INT AS vi, floor((j * 1.0 - 4) / 2 + 0.5)::INT AS vj, floor(k / 3.0::DOUBLE + 0.5)::INT AS vk FROM vox")
def q_vox(spark, sf):
    out = A.mm_to_voxel(D.cells(spark, sf).select("*", F.col("i").alias("x"), F.col("j").alias("y"), F.col("k").alias("z")), AFF)
    return out.select("i", "j", "k", "vi", "vj", "vk")


@query("coordinate_grid", "SELECT i::INT AS i, j::INT AS j, k::INT AS k, 2.0::DOUBLE * i - 10 AS x, 2.0::DOUBLE * j + 4 AS y, 3.0::DOUBLE * k AS z FROM range(0, (SELECT max(l_partkey) FROM lineitem)) a(i), range(0, (SELECT max(l_linenumber) FROM lineitem)) b(j), range(0, 4) c(k)")
def q_cgrid(spark, sf):
    a, b = table(spark, sf, "lineitem").agg(F.max("l_partkey"), F.max("l_linenumber")).first()
    return A.coordinate_grid(spark, (a, b, 4), AFF)


@query("resample_to_atlas", f"WITH {D.VOX}, {D.MASK} SELECT i - 1 AS i, j AS j, k + 1 AS k, value FROM mask")
def q_resample(spark, sf):
    return A.resample_to_atlas(D.mask(spark, sf), AFF, ATL)


_AVG = "own AS (SELECT label_idx, sum(prob * value) AS s FROM atlas JOIN mask USING (i, j, k) GROUP BY label_idx), lbl AS (SELECT DISTINCT atlas, label_idx FROM atlas), tot AS (SELECT sum(value) AS total FROM mask)"


@query("atlas_avg_probability", f"WITH {D.VOX}, {D.MASK}, {D.ATLAS}, {_AVG} SELECT atlas, label_idx, round(coalesce(s / total, 0), 6) AS avg_prob FROM lbl LEFT JOIN own USING (label_idx) CROSS JOIN tot")
def q_avg(spark, sf):
    return A.atlas_avg_probability(D.mask(spark, sf), D.atlas(spark, sf)).withColumn("avg_prob", F.round("avg_prob", 6))


@query("atlas_roi_overlap", f"WITH {D.VOX}, {D.MASK}, {D.ATLAS} SELECT atlas, label_idx, round(sum(prob * coalesce(value, 0)) / sum(prob), 6) AS overlap FROM atlas LEFT JOIN mask USING (i, j, k) GROUP BY atlas, label_idx")
def q_overlap(spark, sf):
    return A.atlas_roi_overlap(D.mask(spark, sf), D.atlas(spark, sf)).withColumn("overlap", F.round("overlap", 6))


@query("atlas_query", f"WITH {D.VOX}, {D.MASK}, {D.ATLAS}, {D.LABELS}, {_AVG} SELECT lbl.atlas, label_idx, coalesce(name, 'Unknown') AS name, round(s / total, 4) AS value FROM lbl JOIN own USING (label_idx) CROSS JOIN tot LEFT JOIN alabels ON idx = label_idx WHERE round(s / total, 4) > 0")
def q_query(spark, sf):
    return A.atlas_query(D.mask(spark, sf), D.atlas(spark, sf), D.atlas_labels(spark, sf))


@query("label_lookup", f"WITH {D.VOX}, {D.ATLAS}, {D.LABELS} SELECT coalesce(name, 'Unknown') AS name, count(*) AS n FROM atlas LEFT JOIN alabels ON idx = label_idx GROUP BY 1")
def q_lookup(spark, sf):
    return A.label_lookup(D.atlas(spark, sf), D.atlas_labels(spark, sf)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("label_centres", "SELECT p_brand AS atlas, p_partkey AS idx, (p_partkey % 35)::INT AS x, p_size AS y, (p_partkey % 9)::INT AS z FROM part")
def q_lcentres(spark, sf):
    k = F.col("p_partkey")
    return A.label_centres(table(spark, sf, "part").select(F.col("p_brand").alias("atlas"), k.alias("idx"), F.col("p_name").alias("name"), (k % 35).cast("int").alias("x"), F.col("p_size").alias("y"), (k % 9).cast("int").alias("z")))


_POINTS = "pts AS (SELECT p_partkey AS point_id, (p_partkey % 4)::INT AS label_idx, (2 * (p_partkey % 35) - 10)::DOUBLE AS x, (2 * (p_size % 33) + 4)::DOUBLE AS y, (3 * (p_partkey % 9))::DOUBLE AS z FROM part)"


def _points(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("point_id"), (k % 4).cast("int").alias("label_idx"), (2 * (k % 35) - 10).cast("double").alias("x"), (2 * (F.col("p_size") % 33) + 4).cast("double").alias("y"), (3 * (k % 9)).cast("double").alias("z"))


@query("point_probability", f"WITH {D.VOX}, {D.ATLAS}, {_POINTS} SELECT point_id, label_idx, CASE WHEN p.x < 54 AND p.y < 68 AND p.z < 24 THEN coalesce(prob, 0) ELSE 0 END AS prob FROM pts p LEFT JOIN (SELECT label_idx, 2.0 * i - 10 AS x, 2.0 * j + 4 AS y, 3.0 * k AS z, prob FROM atlas) USING (label_idx, x, y, z)")
def q_point(spark, sf):
    return A.point_probability(_points(spark, sf), D.atlas(spark, sf), AFF, (32, 32, 8))


@query("point_description", f"""WITH {D.VOX}, {D.ATLAS}, {D.LABELS}, {_POINTS}
SELECT point_id, coalesce(string_agg(printf('%.2f%% ', prob) || coalesce(name, 'Unknown'), ', ' ORDER BY prob DESC, coalesce(name, 'Unknown')) FILTER (prob IS NOT NULL), 'No label found.') AS description
FROM pts LEFT JOIN (SELECT label_idx AS li, 2.0 * i - 10 AS x, 2.0 * j + 4 AS y, 3.0 * k AS z, prob FROM atlas) USING (x, y, z) LEFT JOIN alabels ON idx = li GROUP BY point_id""")
def q_description(spark, sf):
    return A.point_description(_points(spark, sf).drop("label_idx"), D.atlas(spark, sf), D.atlas_labels(spark, sf), AFF)
