"""How plans register their queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) as a query, with its oracle SQL if SQL can express it."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register
