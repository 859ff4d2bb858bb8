"""op12: the prefix trie of all rebuilt conversations."""

from pyspark.sql import DataFrame, SparkSession

from cohortlake.llm.common import read_texts
from cohortlake.llm.trie import conversation_trie


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_texts(spark, sf_dir, "conversations"))


#: unsigned crc32 of a decimal number, bit by bit over its digits
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""

SQL = {
    "op12_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS tok,
    turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, tok) - 1 AS p FROM turns),
convs AS (SELECT conv_id, count(*) AS n, ({_CRC} % 9)::BIGINT AS h FROM own GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, b.p, b.tok, strlen(b.text) AS bytes FROM convs c JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5 AND b.p < c.h
  UNION ALL SELECT c.conv_id, 1, o.p, o.tok, strlen(o.text) FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.p >= c.h),
seqs AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(tok, '') OVER w) AS prefix, bytes FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, p)),
paths AS (
  SELECT conv_id, depth, prefix, bytes, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM seqs
  UNION ALL SELECT conv_id, 0, '', 0, min(conv_id) OVER () FROM convs),
lens AS (SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id),
ends AS (
  SELECT p.depth, p.node, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS digest FROM paths p JOIN lens l ON l.conv_id = p.conv_id AND l.len = p.depth GROUP BY p.depth, p.node),
nodes AS (
  SELECT p.depth, p.node, count(*) AS n_convs, max(p.bytes) AS bytes, max(u.node) AS parent FROM paths p LEFT JOIN paths u ON u.conv_id = p.conv_id AND u.depth = p.depth - 1 GROUP BY p.depth, p.node),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node),
totals AS (
  SELECT p.depth, p.node, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved
  FROM full_nodes b JOIN paths p ON p.conv_id = b.node AND p.depth <= b.depth GROUP BY p.depth, p.node)
SELECT n.node AS conv_id, n.depth, n.parent AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved AS saved_tokens, coalesce(e.digest, sha256('')) AS ends_sha256
FROM full_nodes n JOIN totals t ON t.depth = n.depth AND t.node = n.node LEFT JOIN ends e ON e.depth = n.depth AND e.node = n.node""",
}
