"""Queries of the training-data operators and their SQL."""

from . import bpe, chat, embedding_dedup, lm_score, mixing, ngram_join, prefix_trie, quality, quality_model, source_audit, suffix_dedup, token_shards, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_bpe": bpe.op5_bpe,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_chat": chat.op7_chat,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_shards": token_shards.op9_token_shards,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_quality_model": quality_model.op12_quality_model,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_quality": quality.OP2_SQL,
    "op7_chat": chat.OP7_SQL,
    "op11_source_audit": source_audit.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
