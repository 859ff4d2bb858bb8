"""op11: a manifest of all documents, and which of them still prove after line ends were lost."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import read_texts
from cohortlake.llm.merkle import manifest


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_texts(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = manifest(docs, fields, {"text": F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("sibs", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD.format("{0}") + ")"
#: unsigned crc32 of a decimal number is even: bit by bit over its digits
_EVEN = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) % 2 = 1"""
_STEP = "SELECT {key}lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {t} WHERE n > 1 GROUP BY {key}lvl, pos // 3, n"

SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_EVEN} THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS shown FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
  SELECT source, 0::BIGINT AS lvl, pos, leaf AS h, n FROM placed UNION ALL {_STEP.format(key="source, ", t="tree")}),
tops AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
high AS (SELECT 0::BIGINT AS lvl, pos, subroot AS h, n FROM tops UNION ALL {_STEP.format(key="", t="high")}),
inner_path AS (
  SELECT doc_id, source, leaf, pos AS first_pos, 0::BIGINT AS lvl, pos, shown AS h, '' AS sibs, n FROM placed
  UNION ALL
  SELECT p.doc_id, p.source, p.leaf, p.first_pos, p.lvl + 1, p.pos // 3, sha256(string_agg(CASE WHEN t.pos = p.pos THEN p.h ELSE t.h END, '' ORDER BY t.pos)),
    p.sibs || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> p.pos), ''), (p.n + 2) // 3
  FROM inner_path p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.lvl = p.lvl AND t.pos // 3 = p.pos // 3 WHERE p.n > 1
  GROUP BY p.doc_id, p.source, p.leaf, p.first_pos, p.lvl, p.pos, p.h, p.sibs, p.n),
whole AS (
  SELECT p.doc_id, p.source, p.leaf, p.first_pos, t.subroot, 0::BIGINT AS lvl, t.pos, p.h, p.sibs, t.n FROM inner_path p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source WHERE p.n = 1
  UNION ALL
  SELECT p.doc_id, p.source, p.leaf, p.first_pos, p.subroot, p.lvl + 1, p.pos // 3, sha256(string_agg(CASE WHEN t.pos = p.pos THEN p.h ELSE t.h END, '' ORDER BY t.pos)),
    p.sibs || coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos <> p.pos), ''), (p.n + 2) // 3
  FROM whole p JOIN high t ON t.lvl = p.lvl AND t.pos // 3 = p.pos // 3 WHERE p.n > 1
  GROUP BY p.doc_id, p.source, p.leaf, p.first_pos, p.subroot, p.lvl, p.pos, p.h, p.sibs, p.n)
SELECT w.doc_id, w.leaf, w.subroot, r.h AS root, sha256(w.sibs) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM whole w, (SELECT h FROM high WHERE n = 1) r WHERE w.n = 1""",
}
