"""op10: all documents into 40 shards of near-equal bytes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_texts
from cohortlake.llm.shards import shard_by_bytes


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read_texts(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
