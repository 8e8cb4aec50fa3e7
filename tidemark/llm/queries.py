"""Queries of the operators in this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from tidemark.llm import bpe, compression_quality, decontaminate, license_scan, near_dup, quality_rules, secret_scan, sharding, source_divergence, spelling, suffix_dedup, token_files, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_bpe": bpe.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_near_dup": near_dup.op4,
    "op5_token_files": token_files.op5,
    "op6_sharding": sharding.op6,
    "op7_secret_scan": secret_scan.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_license_scan": license_scan.op9,
    "op10_warc": warc.op10,
    "op11_source_divergence": source_divergence.op11,
    "op12_compression_quality": compression_quality.op12,
    "op13_spelling": spelling.op13,
    "quality_ablations": quality_rules.policy_ablations,
}

SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op3_suffix_dedup": suffix_dedup.OP3_SQL,
    "op4_near_dup": near_dup.OP4_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op9_license_scan": license_scan.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_source_divergence": source_divergence.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
    "quality_ablations": quality_rules.ABLATIONS_SQL,
}
