"""Every query of the library by name, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from versewell.operators import corpus, corrections, dataset, frames, linking, phonology, reports, scoring, signals, sound, texts
from versewell.streaming import live

MODULES = (scoring, reports, linking, frames, texts, corrections, corpus, dataset, phonology, signals, sound, live)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.ORACLE.items()}
