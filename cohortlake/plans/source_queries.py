"""Queries of sources, sinks and hooks: files written by Spark from the driver tables, read back by the library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators import learning as L
from cohortlake.operators import timeseries as T
from cohortlake.operators.tables import new_path
from cohortlake.plans import data as D
from cohortlake.plans.base import query, table
from cohortlake.sources import text as S
from cohortlake.sources import volumes as V


def _customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("line"), F.col("c_name").alias("path"), F.col("c_mktsegment").alias("label"), "c_nationkey", "c_acctbal")


def _logs(spark, sf) -> str:
    """A text file for each nation, its customers as lines of a learning log, in order."""
    path = new_path(spark, "logs")
    c = _customers(spark, sf).select(F.col("c_nationkey").alias("nation"), "line", F.explode(F.array(F.concat(F.lit("start "), "label"), F.concat(F.lit("Accuracy: "), F.col("c_acctbal").cast("string")), F.concat(F.lit("F1: "), F.col("line").cast("string")))).alias("value"))
    c.repartition("nation").sortWithinPartitions("nation", "line", "value").select("nation", "value").write.partitionBy("nation").text(path)
    return path


def _nation(column: str):
    return F.regexp_extract(column, "nation=([0-9]+)", 1).cast("int").alias("nation")


@query("write_lines", "SELECT c_name AS value FROM customer")
def q_write_lines(spark, sf):
    path = new_path(spark, "lines")
    S.write_lines(_customers(spark, sf), "path", path, ["line"])
    return spark.read.text(path)


@query("write_subjects", "SELECT c_name || ':' || c_mktsegment AS value FROM customer")
def q_write_subjects(spark, sf):
    path = new_path(spark, "subjects")
    S.write_subjects(_customers(spark, sf), path)
    return spark.read.text(path)


@query("read_subjects", "SELECT '/data/' || c_name AS path, c_mktsegment AS label FROM customer")
def q_read_subjects(spark, sf):
    path = new_path(spark, "subjects")
    S.write_subjects(_customers(spark, sf), path)
    return S.read_subjects(spark, path, "/data/").select("path", "label")


@query("read_svmperf_log", "SELECT c_nationkey::INT AS nation, arg_min(c_acctbal, c_custkey)::DOUBLE AS \"Accuracy\", min(c_custkey)::DOUBLE AS \"F1\", NULL::DOUBLE AS \"Recall\" FROM customer GROUP BY 1")
def q_log(spark, sf):
    return S.read_svmperf_log(spark, _logs(spark, sf)).select(_nation("file"), "Accuracy", "F1", "Recall")


@query("grep_first", "SELECT c_nationkey::INT AS nation, 'start BUILDING' AS value FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def q_grep(spark, sf):
    return S.grep_first(spark, _logs(spark, sf), "BUILDING").select(_nation("file"), "value")


@query("line_counts", "SELECT c_nationkey::INT AS nation, 3 * count(*) AS lines FROM customer GROUP BY 1")
def q_lines(spark, sf):
    return V.file_stats(spark, f"{_logs(spark, sf)}/*").select(_nation("path"), "lines")


@query("file_sizes", "SELECT c_nationkey::INT AS nation, sum(length(c_mktsegment) + 7 + length(c_acctbal::VARCHAR) + 11 + length(c_custkey::VARCHAR) + 5)::BIGINT AS bytes FROM customer GROUP BY 1")
def q_sizes(spark, sf):
    return V.file_stats(spark, f"{_logs(spark, sf)}/*").select(_nation("path"), "bytes")


@query("read_volumes", f"WITH {D.VOX} SELECT volume_id, i::INT AS i, j::INT AS j, k::INT AS k, 0 AS t, value::DOUBLE AS value FROM vox WHERE value <> 0")
def q_volumes(spark, sf):
    """One file for each volume, with the bytes that the library's encoder gives, by Spark's text writer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((32, 32, 8), dtype="<f8")
        x[pdf["i"], pdf["j"], pdf["k"]] = pdf["value"]
        return pd.DataFrame({"volume_id": pdf["volume_id"].iloc[:1], "value": [V.encode(x)]})

    path = new_path(spark, "volumes")
    files = D.vox(spark, sf).select("volume_id", "i", "j", F.col("k").cast("int").alias("k"), F.col("value").cast("double").alias("value")).groupBy("volume_id").applyInPandas(run, "volume_id string, value binary")
    files.select("volume_id", F.col("value").cast("string").alias("value")).write.partitionBy("volume_id").text(path)
    return V.read_volumes(spark, path).withColumn("volume_id", F.regexp_extract("volume_id", "volume_id=([^/]+)", 1))


@query("save_volume_table", f"WITH {D.VOX}, h AS (SELECT volume_id, 32 AS nx FROM vox GROUP BY 1) SELECT volume_id, i::INT AS i, j::INT AS j, k::INT AS k, value::DOUBLE AS value, nx FROM vox JOIN h USING (volume_id)")
def q_save(spark, sf):
    path = new_path(spark, "table")
    vox = D.vox(spark, sf).select("volume_id", "i", "j", F.col("k").cast("int").alias("k"), F.col("value").cast("double").alias("value"))
    V.save_volume_table(vox, vox.select("volume_id").distinct().withColumn("nx", F.lit(32)), path)
    return spark.read.parquet(f"{path}/voxels").join(spark.read.parquet(f"{path}/headers"), "volume_id").select("volume_id", "i", "j", "k", "value", "nx")


@query("read_atlas_labels", "SELECT left(p_brand, 7) AS atlas, p_partkey::INT AS idx, trim(p_name) AS name, p_size::INT AS x, (p_partkey % 7)::INT AS y, (p_partkey % 11)::INT AS z, 1 AS v FROM part")
def q_atlas_labels(spark, sf):
    """An atlas for each manufacturer: its parts are the labels."""
    path = new_path(spark, "atlas")
    part = table(spark, sf, "part").select(F.substring("p_brand", 1, 7).alias("maker"), F.col("p_partkey").cast("string").alias("p"), F.expr("replace(replace(p_name, '&', '&amp;'), '<', '&lt;')").alias("n"), F.col("p_size").cast("string").alias("s"), (F.col("p_partkey") % 7).cast("string").alias("y"), (F.col("p_partkey") % 11).cast("string").alias("z"))
    label = F.concat(F.lit('<label index="'), "p", F.lit('" x="'), "s", F.lit('" y="'), "y", F.lit('" z="'), "z", F.lit('" v="1">'), "n", F.lit("</label>"))
    for r in part.select("maker").distinct().orderBy("maker").collect():  # manufacturers, a handful
        head, foot = (spark.createDataFrame([(x,)], "value string").coalesce(1) for x in (f"<atlas><header><name>{r['maker']}</name><type>Label</type></header><data>", "</data></atlas>"))
        head.union(part.filter(F.col("maker") == r["maker"]).select(label.alias("value"))).union(foot).coalesce(1).write.mode("append").text(path)
    return S.read_atlas_labels(spark, path)


@query("convert_table", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_mktsegment FROM customer")
def q_convert(spark, sf):
    a, b = new_path(spark, "csv"), new_path(spark, "converted")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", "true").csv(a)
    S.convert_table(spark, a, b, "csv", "json")
    return spark.read.schema("c_custkey long, c_name string, c_mktsegment string").json(b)


@query("export_variables", "SELECT 'part' AS name, p_partkey::BIGINT AS key FROM part UNION ALL SELECT 'orders', o_orderkey::BIGINT FROM orders")
def q_export(spark, sf):
    path = new_path(spark, "variables")
    tables = {"part": table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("key")), "orders": table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("key"))}
    S.export_variables(tables, path, "parquet")
    return spark.read.parquet(f"{path}/part").select(F.lit("part").alias("name"), "key").union(spark.read.parquet(f"{path}/orders").select(F.lit("orders").alias("name"), "key"))


@query("register_selector", f"WITH {D.SERIES} SELECT volume_id, roi, t::INT AS t, round(max(x) - min(x), 6) + 0.0 AS x FROM long WHERE roi <> 0 GROUP BY 1, 2, 3")
def q_selector(spark, sf):
    T.register_selector("range", lambda m: m.max(axis=0) - m.min(axis=0))
    out = T.select_timeseries(D.series(spark, sf).filter("roi <> 0"), "range")
    return out.select("volume_id", "roi", F.posexplode("ts").alias("t", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query("register_measure", f"WITH {D.SERIES} SELECT a.volume_id, a.roi AS roi_a, b.roi AS roi_b, round(sum(a.x * b.x), 5) + 0.0 AS value FROM ml a JOIN ml b USING (volume_id, t) WHERE a.roi <> 0 AND b.roi <> 0 GROUP BY 1, 2, 3")
def q_measure(spark, sf):
    T.register_measure("dot", lambda a, b: float(a @ b))
    return T.functional_connectivity(D.series(spark, sf), measure="dot").withColumn("value", F.round("value", 5) + 0.0)


def _matrix(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), (F.col("label") % 2).cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


_TOTAL = "s AS (SELECT vec_id, label % 2 AS y, list_sum(embedding::DOUBLE[]) AS x FROM embeddings)"


@query("classifier", f"""WITH {_TOTAL}, m AS (SELECT y, ln(count(*) / (SELECT count(*) FROM s)) - 0.5 * ln(var_pop(x) + 1e-6) AS c, avg(x) AS mu, var_pop(x) + 1e-6 AS v FROM s GROUP BY y)
SELECT vec_id AS sample_id, arg_max(m.y, c - 0.5 * (x - mu) * (x - mu) / v)::DOUBLE AS prediction FROM s CROSS JOIN m GROUP BY vec_id""")
def q_classifier(spark, sf):
    """Gaussian classes on the sum of each sample's features."""
    e = table(spark, sf, "embeddings")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    rows = e.select(F.col("vec_id").alias("sample_id"), (F.col("label") % 2).cast("double").alias("y"), array_to_vector(F.array(total)).alias("features"))
    model, _ = L.classifier("gmm")
    return model.fit(rows).transform(rows).select("sample_id", "prediction")


@query("feature_selector", """WITH f AS (SELECT label % 2 AS y, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
 g AS (SELECT p, avg(x) AS m, count(*) AS n FROM f GROUP BY p), c AS (SELECT p, y, avg(x) AS mc, count(*) AS nc, var_pop(x) * count(*) AS w FROM f GROUP BY p, y),
 s AS (SELECT p, (sum(nc * (mc - m) * (mc - m)) / (count(*) - 1)) / (sum(w) / (any_value(n) - count(*))) AS score FROM c JOIN g USING (p) GROUP BY p)
SELECT p::INT AS feature_id FROM s ORDER BY score DESC LIMIT 10""")
def q_feature_selector(spark, sf):
    """The ten features of the largest analysis-of-variance score."""
    model = L.feature_selector("anova", k=10).fit(_matrix(spark, sf))
    return spark.createDataFrame([(int(i),) for i in model.selectedFeatures], "feature_id int")


_STEP = """f AS (SELECT vec_id, CASE WHEN label % 2 = 1 THEN 1.0::DOUBLE ELSE -1 END AS t, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
 w AS (SELECT p, 0.5 * avg(t * x) / (1 + 0.5 * 0.01) AS w FROM f GROUP BY p), b AS (SELECT 0.5 * avg(t) AS b FROM f WHERE p = 1)"""


@query("classifier_sgd", f"WITH {_STEP} SELECT vec_id AS sample_id, CASE WHEN sum(x * w) + any_value(b) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM f JOIN w USING (p) CROSS JOIN b GROUP BY vec_id")
def q_classifier_sgd(spark, sf):
    """The first step of all rows from no weights, with the hinge's slope."""
    e, maps = L.classifier("sgd", grid=[{"loss": "hinge", "penalty": "l2", "alpha": 0.01, "epochs": 1, "batches": 1}])
    rows = _matrix(spark, sf).withColumn("weight", F.lit(1.0))
    return e.copy(maps[0]).fit(rows).transform(rows).select("sample_id", "prediction")


@query("classifier_percep")
def q_classifier_percep(spark, sf):
    """Perceptrons mixed over eight shards, each candidate's weights in the same passes."""
    e, maps = L.classifier("percep", grid=[{"penalty": "none", "epochs": 5}, {"penalty": "l2", "alpha": 0.001, "epochs": 5}])
    rows = _matrix(spark, sf).withColumn("weight", F.lit(1.0))
    out = None
    for i, model in e.fitMultiple(rows, maps):
        got = model.transform(rows).select(F.lit(i).alias("candidate"), "sample_id", "prediction")
        out = got if out is None else out.union(got)
    return out


@query("classifier_mixture")
def q_classifier_mixture(spark, sf):
    """Two tied Gaussians for each class."""
    e, maps = L.classifier("gmm", grid=[{"nComponents": 2, "covarianceType": "tied"}])
    rows = _matrix(spark, sf)
    return e.fit(rows, maps[0]).transform(rows).select("sample_id", "prediction")


@query("feature_selector_rpca", "WITH f AS (SELECT vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT p, avg(x) AS mu FROM f GROUP BY p) SELECT vec_id AS sample_id, round(sum((x - mu) * (x - mu)), 5) + 0.0 AS energy FROM f JOIN m USING (p) GROUP BY 1")
def q_selector_rpca(spark, sf):
    """All randomised components of a sample together hold its distance to the mean."""
    rows = _matrix(spark, sf)
    out = L.feature_selector("rpca", k=64).fit(rows).transform(rows)
    energy = F.aggregate(vector_to_array("selected"), F.lit(0.0), lambda a, v: a + v * v)
    return out.select("sample_id", (F.round(energy, 5) + 0.0).alias("energy"))


@query("feature_selector_lda")
def q_selector_lda(spark, sf):
    """Each sample along the direction that parts the two classes best."""
    rows = _matrix(spark, sf)
    out = L.feature_selector("lda").fit(rows).transform(rows)
    return out.select("sample_id", F.round(vector_to_array("selected")[0], 6).alias("score"))


@query("feature_selector_extratrees")
def q_selector_extratrees(spark, sf):
    """Importance of each feature in ten extremely randomised trees."""
    stage = L.feature_selector("extratrees")
    score = stage.copy({stage.trees: 10}).fit(_matrix(spark, sf)).featureImportances
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(score)], "feature_id int, importance double")


@query("build_pipeline_bayes", """WITH f AS (SELECT vec_id, label % 2 AS y, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS x FROM embeddings),
 g AS (SELECT p, avg(x) AS m, count(*) AS n FROM f GROUP BY p), c AS (SELECT p, y, avg(x) AS mc, count(*) AS nc, var_pop(x) AS v FROM f GROUP BY p, y),
 s AS (SELECT p, (sum(nc * (mc - m) * (mc - m)) / (count(*) - 1)) / (sum(nc * v) / (any_value(n) - count(*))) AS score FROM c JOIN g USING (p) GROUP BY p),
 u AS ((SELECT p FROM s ORDER BY score DESC LIMIT 5) UNION ALL (SELECT p FROM s ORDER BY score DESC LIMIT 3)),
 pr AS (SELECT y, ln(count(*) / (SELECT count(*) FROM embeddings)) AS prior FROM (SELECT label % 2 AS y FROM embeddings) GROUP BY y),
 l AS (SELECT vec_id, c.y, any_value(prior) - 0.5 * sum(ln(v + 1e-6) + (x - mc) * (x - mc) / (v + 1e-6)) AS l FROM f JOIN u USING (p) JOIN c ON c.p = f.p JOIN pr ON pr.y = c.y GROUP BY vec_id, c.y)
SELECT vec_id AS sample_id, arg_max(y, l)::DOUBLE AS prediction FROM l GROUP BY vec_id""")
def q_build_pipeline_bayes(spark, sf):
    """Two selectors side by side, then one diagonal Gaussian for each class."""
    rows = _matrix(spark, sf)
    parts = [L.feature_selector("anova", out="sel0", k=5), L.feature_selector("anova", out="sel1", k=3)]
    bayes, maps = L.classifier("gmm", grid=[{"nComponents": 1, "covarianceType": "diag"}])
    return L.build_pipeline(parts, bayes).fit(rows, maps[0]).transform(rows).select("sample_id", "prediction")


@query("build_pipeline")
def q_build_pipeline(spark, sf):
    """Two selectors side by side, then a tree: the class of each sample."""
    rows = _matrix(spark, sf)
    parts = [L.feature_selector("anova", out="sel0", k=5), L.feature_selector("pca", out="sel1", k=3)]
    tree = DecisionTreeClassifier(labelCol="y", featuresCol="features", maxDepth=3, seed=0)
    return L.build_pipeline(parts, tree).fit(rows).transform(rows).select("sample_id", "prediction")
