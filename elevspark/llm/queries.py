"""The registered queries of this folder and their DuckDB equivalents."""

from __future__ import annotations

from . import exact_dedup, langid, mixing, packing, quality_model, quality_rules, secrets, simhash, tokens, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash": simhash.op4_simhash,
    "op5_pack_documents": packing.op5_pack_documents,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_scan_secrets": secrets.op8_scan_secrets,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_mix_sources": mixing.op10_mix_sources,
}

SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
}
