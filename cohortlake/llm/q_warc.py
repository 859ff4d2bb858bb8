"""op5: all pages through WARC archives and back."""

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm.common import read_texts
from cohortlake.llm.warc import archived, key_of


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archived(read_texts(spark, sf_dir, "pages")).filter("kind = 'record'")
    return back.select(key_of(back["record_id"]).alias("page_id"), "payload_bytes", "payload_digest", "record_type", key_of(back["refers_to"]).alias("refers_to"))
