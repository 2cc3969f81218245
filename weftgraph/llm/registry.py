"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from weftgraph.llm import bpe_words, embedding_dedup, exact_dedup, minmax_dedup, packing, quality, sharding, token_counts, token_files, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_quality": quality.op3_quality,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_minmax_dedup": minmax_dedup.op5_minmax_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe_words": bpe_words.op8_bpe_words,
    "op9_sharding": sharding.op9_sharding,
    "op10_packing": packing.op10_packing,
}

ORACLE_SQL = {
    "op2_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_minmax_dedup": minmax_dedup.ORACLE_SQL,
}
