"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: query -> module that holds it; a module may also hold ORACLE_SQL for its query
MODULES = {
    "op1_lm_score": "lm_score",
    "op2_url_filter": "url_filter",
    "op3_decontam": "decontam",
    "op4_language": "language",
    "op5_chat": "chat",
    "op6_near_dup": "near_dup",
    "op7_sharding": "sharding",
    "op8_ann": "ann",
    "op9_bpe": "bpe",
    "op10_secrets": "secret_scan",
    "op11_prefix_trie": "prefix_trie",
    "op12_align_tokens": "align_tokens",
    "op13_jaccard_join": "jaccard_join",
}


def _module(name: str):
    return importlib.import_module(f"versewell.llm.{MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
