"""All queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from opinara.llm import queries_documents, queries_text, queries_vectors

MODULES = [queries_text, queries_documents, queries_vectors]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
