"""op7: all documents joined with each other by five-word shingles at a similarity of 0.8."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_texts
from cohortlake.llm.jaccard import similar


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar(read_texts(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("k").alias("doc_id"), "class_id", "n_links", "copy_of")
