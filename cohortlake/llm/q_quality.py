"""op9: base counts and the fertility verdict of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_texts
from cohortlake.llm.quality import judged


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read_texts(spark, sf_dir).select("doc_id", "text", "lang"))
    counts = [F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "piece_chars_per_token", "piece_byte_share", "piece_entropy", "multi_chars_per_token", "multi_byte_share", "multi_entropy")]
    return out.select("doc_id", *counts, "base_failed", "kept")
