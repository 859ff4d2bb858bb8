"""op4: all documents against all benchmark items."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_table, read_texts
from cohortlake.llm.decontamination import find_benchmark, n_hit


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_texts(spark, sf_dir).select("doc_id", "text")
    out = find_benchmark(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id", "leaks")
    return out.select(
        "doc_id",
        F.col("leaks.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaks.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op4_decontamination": f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
spans AS (SELECT DISTINCT item, n, list_slice(w, s, s + n - 1) AS span FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM spans),
places AS (SELECT r, n, s, list_slice(w, s, s + n - 1) AS span FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, n, s, item FROM places JOIN spans USING (n, span)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, n, s FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
}
