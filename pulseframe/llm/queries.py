"""The queries of this subpackage, and the SQL that says the same."""

from __future__ import annotations

import importlib

#: query -> module that defines a function of that name
MODULES = {
    "op1_benchmark_decontamination": "decontam",
    "op2_token_counts": "tokencount",
    "op3_license_scan": "licenses",
    "op4_substring_dedup": "substring",
    "op5_quality_rules": "quality",
    "op6_stupid_backoff": "lm",
    "op7_retrieval_packing": "packing",
    "op8_jaccard_join": "jaccard",
    "op9_html_extraction": "html",
    "op10_histogram_sharding": "sharding",
    "op11_hard_negatives": "negatives",
    "op12_lexical_search": "lexical",
    "op13_url_filter": "urls",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", {}).get(name)
        if sql:
            found[name] = sql
    return found
