"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from sieveline.llm import oracles, queries as made


def queries() -> dict:
    return {name: f for name, f in vars(made).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
