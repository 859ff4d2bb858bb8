"""op2: all documents into sequences of at most 1024 tokens."""

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm.common import read_texts
from cohortlake.llm.packing import pack


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_texts(spark, sf_dir), special=True)
