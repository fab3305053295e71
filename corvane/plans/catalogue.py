"""The catalogue of registered queries and their DuckDB counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "r20_flagship_search"


def register(name: str, sql: str | None = None):
    """Adds a query; sql is what DuckDB runs for the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


from corvane.plans import q_consolidation, q_core, q_evaluation, q_graph, q_index, q_more, q_retrieval  # noqa: E402, F401  the modules register their queries
