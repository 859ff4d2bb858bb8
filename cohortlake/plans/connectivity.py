"""Functional connectivity of regions."""

from pyspark.sql import functions as F

from cohortlake.operators.timeseries import functional_connectivity as connectivity
from cohortlake.plans.base import query, table


@query("functional_connectivity", """
WITH long AS (SELECT label AS roi, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS t FROM embeddings WHERE label <> 0),
 m AS (SELECT roi, t, avg(x) AS x FROM long GROUP BY roi, t)
SELECT a.roi AS roi_a, b.roi AS roi_b, round(corr(a.x, b.x), 6) + 0.0 AS r FROM m a JOIN m b USING (t) GROUP BY 1, 2""")
def functional_connectivity(spark, sf):
    """All series as one scan."""
    e = table(spark, sf, "embeddings").select(F.lit(0).alias("volume_id"), F.col("vec_id").alias("voxel_id"), F.col("label").alias("roi"), F.col("embedding").cast("array<double>").alias("ts"))
    return connectivity(e).select("roi_a", "roi_b", (F.round("value", 6) + 0.0).alias("r"))
