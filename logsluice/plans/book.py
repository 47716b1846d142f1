"""A book of queries: name -> (function of session and data folder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import D_LOGS, D_SCORED


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable[..., DataFrame]) -> Callable:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep


def on_logs(sql: str, *views: str) -> str:
    return "WITH " + ", ".join([D_LOGS, *views]) + " " + sql


def on_scored(sql: str, *views: str) -> str:
    return "WITH " + ", ".join([D_LOGS, D_SCORED, *views]) + " " + sql


def rule_case(text: str, rules: list, k: int) -> str:
    """SQL for a rule list's first match: item k of (category, rule, confidence)."""
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    arms = [f"WHEN regexp_matches({text}, '{'|'.join(f'(?:{p})' for p in r[3])}', 'i') THEN {quote(r[k])}" for r in rules]
    return "CASE " + " ".join(arms)


def decided() -> str:
    from ..functions.values import PRIORITY, RULES

    ordered = [r for c in PRIORITY for r in RULES if r[0] == c]
    return (
        f"decisions AS (SELECT *, {rule_case('message', ordered, 0)} ELSE 'routine' END AS category, {rule_case('message', ordered, 1)} END AS rule, CAST({rule_case('message', ordered, 2)} ELSE 0.5 END AS DOUBLE) AS confidence FROM logs)"
    )
