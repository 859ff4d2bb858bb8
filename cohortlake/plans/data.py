"""The driver tables in the roles of the library's data model, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.plans.base import table

VOX = "vox AS (SELECT l_returnflag AS volume_id, (l_partkey % 32)::INT AS i, (l_suppkey % 32)::INT AS j, l_linenumber AS k, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4)"
MASK = "mask AS (SELECT i, j, k, value FROM vox WHERE volume_id = 'N' AND value > 60)"
ROIS = "rois AS (SELECT DISTINCT i, j, k, ((i // 8 + 4 * (j // 8)) % 6)::INT AS roi FROM vox)"
ATLAS = "atlas AS (SELECT 'demo' AS atlas, l.idx AS label_idx, i, j, k, ((i * 7 + j * 3 + k * 11 + l.idx * 5) % 101)::DOUBLE AS prob FROM (SELECT DISTINCT i, j, k FROM vox) CROSS JOIN (SELECT unnest(range(0, 6))::INT AS idx) l WHERE (i * 7 + j * 3 + k * 11 + l.idx * 5) % 101 > 40)"
LABELS = "alabels AS (SELECT 'demo' AS atlas, r_regionkey AS idx, r_name AS name, (r_regionkey * 3)::INT AS x, (r_regionkey * 2)::INT AS y, r_regionkey::INT AS z FROM region)"
FEAT = "feat AS (SELECT vec_id AS sample_id, (generate_subscripts(embedding, 1) - 1)::INT AS feature_id, unnest(embedding)::DOUBLE AS value FROM embeddings), lab AS (SELECT vec_id AS sample_id, label % 3 AS y FROM embeddings)"
MOM = "mom AS (SELECT feature_id, y, count(*) AS n, avg(value) AS mean, var_pop(value) AS v FROM feat JOIN lab USING (sample_id) GROUP BY 1, 2)"
SERIES = "series AS (SELECT 'v' || (vec_id % 2) AS volume_id, vec_id AS voxel_id, label AS roi, embedding::DOUBLE[] AS ts FROM embeddings), long AS (SELECT volume_id, voxel_id, roi, generate_subscripts(ts, 1) - 1 AS t, unnest(ts) AS x FROM series), ml AS (SELECT volume_id, roi, t, avg(x) AS x FROM long GROUP BY 1, 2, 3)"
IDS = "ids AS (SELECT o_orderpriority AS set_name, CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE 'C' || o_custkey END AS id, 'O' || o_orderkey AS ref, o_orderkey AS pos FROM orders)"
FILES = "files AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages WHERE url IS NOT NULL)"
TAGS = "tags AS (SELECT c_name AS file, 16 AS grp, 16 AS elem, 'PN' AS vr, 'PatientName' AS keyword, c_name AS value FROM customer UNION ALL SELECT c_name, 16, 48, 'DA', 'PatientBirthDate', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_name, 16, 4096, 'LO', 'OtherPatientIDs', c_mktsegment FROM customer UNION ALL SELECT c_name, 16, 4160, 'LO', 'PatientAddress', c_mktsegment FROM customer UNION ALL SELECT c_name, 20480 + 2 * c_nationkey, 5, 'US', 'CurveDimensions', '1' FROM customer UNION ALL SELECT c_name, 9 + c_nationkey, 1, 'LO', 'Vendor', c_mktsegment FROM customer)"
PRED = "pred AS (SELECT 'c' || (doc_id % 3) AS config_id, (doc_id % 10)::INT AS fold, doc_id AS sample_id, quality AS y_true, 1 - toxic AS y_pred FROM labels)"
SEL = "sel AS (SELECT 'p' || (l_suppkey % 6) AS config_id, (l_linenumber % 5)::INT AS fold, l_partkey AS feature_id, max(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2, 3)"
EVENTS = "ev AS (SELECT (user_id % 20)::INT AS grp, event_type, value, user_id FROM events)"
PRICES = "vals AS (SELECT p_brand AS grp, p_partkey AS feature_id, p_retailprice AS value FROM part)"


def vox(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("volume_id"), (F.col("l_partkey") % 32).cast("int").alias("i"), (F.col("l_suppkey") % 32).cast("int").alias("j"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("value"))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return vox(spark, sf).filter("volume_id = 'N' and value > 60").select("i", "j", "k", "value")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 32).cast("int").alias("i"), (F.col("l_suppkey") % 32).cast("int").alias("j"), F.col("l_linenumber").alias("k")).distinct()


def rois(spark: SparkSession, sf: str) -> DataFrame:
    return cells(spark, sf).withColumn("roi", F.expr("cast((i div 8 + 4 * (j div 8)) % 6 as int)"))


def atlas(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).withColumn("label_idx", F.explode(F.array(*[F.lit(x) for x in range(6)])))
    p = F.expr("(i * 7 + j * 3 + k * 11 + label_idx * 5) % 101")
    return c.withColumn("p", p).filter("p > 40").select(F.lit("demo").alias("atlas"), "label_idx", "i", "j", "k", F.col("p").cast("double").alias("prob"))


def atlas_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey").cast("int")
    return table(spark, sf, "region").select(F.lit("demo").alias("atlas"), k.alias("idx"), F.col("r_name").alias("name"), (k * 3).alias("x"), (k * 2).alias("y"), k.alias("z"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("feature_id", "value")).withColumn("value", F.col("value").cast("double"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") % 3).alias("y"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.concat(F.lit("v"), (F.col("vec_id") % 2).cast("string")).alias("volume_id"), F.col("vec_id").alias("voxel_id"), F.col("label").alias("roi"), F.col("embedding").cast("array<double>").alias("ts"))


def ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("set_name"), F.when(F.col("o_custkey") % 97 != 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("id"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("ref"), F.col("o_orderkey").alias("pos"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf, "pages").filter("url is not null").select(p.alias("path")).distinct()


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr("c_name as file", "stack(6, 16, 16, 'PN', 'PatientName', c_name, 16, 48, 'DA', 'PatientBirthDate', cast(c_nationkey as string), 16, 4096, 'LO', 'OtherPatientIDs', c_mktsegment, 16, 4160, 'LO', 'PatientAddress', c_mktsegment, 20480 + 2 * c_nationkey, 5, 'US', 'CurveDimensions', '1', 9 + c_nationkey, 1, 'LO', 'Vendor', c_mktsegment) as (grp, elem, vr, keyword, value)")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("config_id"), (F.col("doc_id") % 10).cast("int").alias("fold"), F.col("doc_id").alias("sample_id"), F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))


def selections(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.concat(F.lit("p"), (F.col("l_suppkey") % 6).cast("string")).alias("config_id"), (F.col("l_linenumber") % 5).cast("int").alias("fold"), F.col("l_partkey").alias("feature_id")).agg(F.max(F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)).alias("weight"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 20).cast("int").alias("grp"), "event_type", "value", "user_id")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("value"))
