"""op8: all documents without the runs of lines that an earlier document holds."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_texts
from cohortlake.llm.lines import dedup_lines


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_texts(spark, sf_dir).select("doc_id", "text"))
    deleted = F.coalesce(F.col("repeats.deleted"), F.array().cast("array<int>"))
    return out.select("doc_id", "text", F.size(deleted).cast("long").alias("n_deleted"), deleted.alias("deleted_lines"), F.coalesce(F.col("repeats.owners"), F.array().cast("array<bigint>")).alias("earlier_ids"))
