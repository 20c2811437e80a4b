"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import byte_bpe, licenses, ngram_join, packing, pii, quality, secrets, topk, vector_dedup, word_tokens

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_token_counts": word_tokens.op3_token_counts,
    "op4_pii": pii.op4_pii,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_embedding_dedup": vector_dedup.op9_embedding_dedup,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
}
ORACLE_SQL = {**licenses.ORACLE, **ngram_join.ORACLE, **topk.ORACLE, **vector_dedup.ORACLE}
