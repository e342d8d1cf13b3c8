"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from stmtlens.llm import (
    byte_bpe, embeddings, language_model, line_dedup, packing, pii, quality, resampling, sharding, simhash,
    subwords, token_counts, vector_codes,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_pii": pii.op2_pii,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality": quality.op5_quality,
    "op6_bpe": byte_bpe.op6_bpe,
    "op7_language_model": language_model.op7_language_model,
    "op8_simhash": simhash.op8_simhash,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_quality_classifier": subwords.op13_quality_classifier,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_sharding": sharding.OP1_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_importance_resampling": resampling.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
