"""op3: all documents scored by a hierarchical Pitman-Yor model and by add-one counts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_texts
from cohortlake.llm.pitman_yor import score_texts


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_texts(spark, sf_dir).select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
