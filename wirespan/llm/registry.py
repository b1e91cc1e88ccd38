"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

#: Query name: module of this subpackage that has it and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_near_dedup": "near_dedup",
    "op2_line_dedup": "line_dedup",
    "op3_exact_dedup": "exact_dedup",
    "op4_packing": "packing",
    "op5_url_filter": "url_filter",
    "op6_lm_scoring": "lm_scoring",
    "op7_html_text": "html_text",
    "op8_fingerprint": "fingerprint",
    "op9_language_id": "language_id",
    "op10_bpe": "bpe",
    "op11_whitening": "whitening",
    "op12_vector_dedup": "vector_dedup",
    "op13_spelling": "spelling",
}


def queries() -> dict:
    return {name: getattr(import_module(f"wirespan.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f"wirespan.llm.{module}") for name, module in MODULES.items()}
    return {name: m.ORACLE_SQL for name, m in modules.items() if getattr(m, "ORACLE_SQL", None)}
