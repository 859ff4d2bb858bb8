"""The queries of this subpackage and their SQL twins."""

from cohortlake.llm import q_chat, q_decontamination, q_jaccard, q_lines, q_merkle, q_packing, q_pitman_yor, q_quality, q_shards, q_substrings, q_toxicity, q_trie, q_warc

_QUERIES = [q_chat.op1_chat_formatting, q_packing.op2_best_fit_packing, q_pitman_yor.op3_lm_scoring, q_decontamination.op4_decontamination, q_warc.op5_warc, q_toxicity.op6_toxicity, q_jaccard.op7_ngram_jaccard, q_lines.op8_line_dedup, q_quality.op9_quality_rules, q_shards.op10_sharding, q_merkle.op11_merkle_manifest, q_trie.op12_prefix_trie, q_substrings.op13_substring_dedup]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict:
    return {**q_chat.SQL, **q_decontamination.SQL, **q_merkle.SQL, **q_trie.SQL, **q_substrings.SQL}
