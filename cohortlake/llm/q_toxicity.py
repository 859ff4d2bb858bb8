"""op6: all documents scored for toxicity, learnt from the labels of four fifths."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_table, read_texts
from cohortlake.llm.toxicity import fit, score


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_texts(spark, sf_dir).select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    out = score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
