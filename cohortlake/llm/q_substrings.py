"""op13: all documents without the passages that stand twice."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_texts
from cohortlake.llm.substrings import dedup_substrings


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_texts(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


SQL = {
    "op13_substring_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
spans AS (
  SELECT row, start, array_to_string(words[start : start + 34], ' ') AS span FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS start FROM docs)),
twice AS (SELECT row, start FROM (SELECT row, start, count(*) OVER (PARTITION BY span) AS n FROM spans) WHERE n > 1),
gone AS (SELECT DISTINCT row, unnest(range(start, start + 35)) AS place FROM twice),
lost AS (SELECT row, list(place) AS ats FROM gone GROUP BY row),
kept AS (
  SELECT d.doc_id, d.words, CASE WHEN l.ats IS NULL THEN d.words ELSE list_filter(d.words, lambda w, i: NOT list_contains(l.ats, i)) END AS own FROM docs d LEFT JOIN lost l ON l.row = d.row)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(own))::BIGINT AS n_removed, sha256(array_to_string(own, ' ')) AS kept_sha256 FROM kept""",
}
