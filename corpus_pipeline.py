"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Other tables (labels,
benchmark) are read from sf_dir.

In every stage a null doc_id is a key like others, null texts are empty ones and stay null where they are kept, nulls in
other columns pass, and so do other columns, whatever their names (but for those that begin with two underscores). An
empty table gives an empty result. Equal rows are treated alike, and near_duplicates keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_table, read_texts, stored
from cohortlake.llm.decontamination import find_benchmark, n_hit
from cohortlake.llm.jaccard import keep_one
from cohortlake.llm.lines import dedup_lines
from cohortlake.llm.packing import pack
from cohortlake.llm.toxicity import fit, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather toxic than not go. Null and empty texts hold no passage, so they get the score of clean
    ones and stay; a row without a doc_id has no label to learn from but is scored. Without labels all have one score,
    the share of toxic rows."""
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model, into="__toxicity").filter("__toxicity.score < 0.5").drop("__toxicity")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document go from the later one; n_chars follows the text. All rows stay: a text
    that is repeated whole becomes empty. A null doc_id comes after all others."""
    out = dedup_lines(docs, into="__repeats")
    return out.withColumn("n_chars", F.when(F.col("__repeats").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id; of equal rows one. Texts without
    a word, null included, are one group; a null doc_id comes after all others."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go. Without benchmark items all stay."""
    return find_benchmark(docs, read_table(spark, sf_dir, "benchmark"), into="__leaks").filter(n_hit("__leaks") == 0).drop("__leaks")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 1024 tokens, one row for each piece of a document. A null or empty
    text is its end token alone."""
    return pack(docs, special=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each but the last is written as Parquet and read again."""
    docs = read_texts(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
