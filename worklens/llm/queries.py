"""The registered queries of this folder."""

from __future__ import annotations

from worklens.llm import (
    boilerplate, decontamination, filter_audit, language_model, mixing, ngram_join, pieces, quality, sharding,
    substring_dedup, token_counts, vector_search, whitening,
)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_sharding": sharding.op2_sharding,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_line_dedup": boilerplate.op8_line_dedup,
    "op9_lm_scoring": language_model.op9_lm_scoring,
    "op10_vector_search": vector_search.op10_vector_search,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
ORACLE_SQL = {
    "op8_line_dedup": boilerplate.ORACLE,
    "op10_vector_search": vector_search.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
