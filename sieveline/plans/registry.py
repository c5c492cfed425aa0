"""The queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

import re

from sieveline.plans import oracles, queries as made


def queries() -> dict:
    return {n: f for n, f in vars(made).items() if callable(f) and (re.match(r"[a-l]\d+_", n) or n == "moderation_prf")}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
