"""Queries of the text operators: name to (callable, check SQL or None)."""

from __future__ import annotations

from tidemark.llm import (
    conversation_repair, decontaminate, exact_dedup, fill_middle, hamming_join, line_dedup, ngram_join, packing, preference,
    substring_dedup, surrogates, toxicity, url_filter,
)

MODULES = [
    substring_dedup, toxicity, ngram_join, surrogates, line_dedup, preference, url_filter, decontaminate, exact_dedup, packing,
    conversation_repair, fill_middle, hamming_join,
]


def all_queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
