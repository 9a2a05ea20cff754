"""All registered queries, collected from the query modules."""

from __future__ import annotations

from . import (
    queries_audit,
    queries_decode,
    queries_payroll,
    queries_reads,
    queries_streams,
    queries_tokens,
    queries_writes,
)

_MODULES = (
    queries_tokens, queries_decode, queries_writes, queries_payroll, queries_reads, queries_audit,
    queries_streams,
)


def queries() -> dict:
    return {name: q.run for m in _MODULES for name, q in m.BOOK.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for m in _MODULES for name, q in m.BOOK.items() if q.sql}
