"""Registry of end-to-end queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's parquet
tables.  Doubles are rounded half-up to 4 decimals as floor(x*1e4+0.5)/1e4 on
both sides so the value hashes agree; counts and ranks are bigint on both.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def R4(expr: str) -> str:
    """SQL text of the shared 4-decimal rounding."""
    return f"(floor(({expr})*1e4+0.5)/1e4)"


def load_all() -> None:
    """Import every query module so the decorators run."""
    from notewise.plans import q_cluster, q_merge, q_models, q_search, q_text, q_topics  # noqa: F401
