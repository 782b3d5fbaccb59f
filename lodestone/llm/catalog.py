"""Registered queries of this subpackage and their oracle SQL."""

from lodestone.llm import context_mixing, exact_dedup, hnsw_dedup, line_dedup, minhash_dedup, mixing, pieces, token_output, toxicity, url_rules

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_lm_scoring": context_mixing.op7_lm_scoring,
    "op8_embedding_dedup": hnsw_dedup.op8_embedding_dedup,
    "op9_minhash_dedup": minhash_dedup.op9_minhash_dedup,
    "op10_source_mixing": mixing.op10_source_mixing,
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_url_rules": url_rules.ORACLE,
    "op8_embedding_dedup": hnsw_dedup.ORACLE,
    "op9_minhash_dedup": minhash_dedup.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
}
