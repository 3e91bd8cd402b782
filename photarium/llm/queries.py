"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from photarium.llm import byte_bpe, embeddings, langid, mixing, quality, recompression, simhash, tokencounts, tokenfile, urlfilter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": langid.op2_language_id,
    "op3_simhash_dedup": simhash.op3_simhash_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_token_counts": tokencounts.op5_token_counts,
    "op6_substring_dedup": recompression.op6_substring_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_url_filter": urlfilter.op8_url_filter,
    "op9_token_file": tokenfile.op9_token_file,
    "op10_embedding_dedup": embeddings.op10_embedding_dedup,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
}
