"""The queries of this subpackage and what DuckDB can answer of them."""

from __future__ import annotations

import corpus_pipeline
from sonde.llm import context_tree, decontaminate, license_scan, line_templates, mixing, quality_rules, simhash, suffix_dedup, token_counts, token_store

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_token_store": token_store.op3_token_store,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_context_tree": context_tree.op6_context_tree,
    "op7_line_templates": line_templates.op7_line_templates,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op7_line_templates": line_templates.ORACLE,
    "op10_license_scan": license_scan.ORACLE,
}
