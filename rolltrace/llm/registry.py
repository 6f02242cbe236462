"""Queries and SQL of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_secret_scan": "secret_scan",
    "op3_best_fit_packing": "packing",
    "op4_ngram_jaccard_join": "jaccard_join",
    "op5_license_scan": "license_scan",
    "op6_quality_rules": "quality_rules",
    "op7_token_count": "token_count",
    "op8_byte_bpe": "byte_bpe",
    "op9_exact_dedup": "exact_dedup",
    "op10_url_filter": "url_filter",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{_MODULES[name]}")


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(_module(name), name) for name in _MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: getattr(_module(name), "ORACLE_SQL", None) for name in _MODULES} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
