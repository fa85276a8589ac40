"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: query -> (module, SQL attribute or None)
OPERATORS = {
    "op1_suffix_array_dedup": ("op1_suffix_dedup", "SQL"),
    "op2_ngram_jaccard": ("op2_ngram_jaccard", "SQL"),
    "op3_language_id": ("op3_language_id", None),
    "op4_line_dedup": ("op4_line_dedup", "SQL"),
    "op5_pii": ("op5_pii", None),
    "op6_quality_rules": ("op6_quality_rules", "SQL"),
    "op7_substring_dedup": ("op7_substring_dedup", "SQL"),
    "op8_source_mix": ("op8_source_mix", "SQL"),
    "op9_url_filters": ("op9_url_filters", "SQL"),
    "op10_benchmark_decontamination": ("op10_decontamination", "SQL"),
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {q: getattr(_module(m), q) for q, (m, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(_module(m), sql) for q, (m, sql) in OPERATORS.items() if sql}
