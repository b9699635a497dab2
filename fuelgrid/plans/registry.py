"""All queries of the library: name -> function of (spark, folder of tables), and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (tables) under a name; ``sql`` is its statement in the other engine's dialect."""

    def put(f: Callable) -> Callable:
        from .adapters import Tables

        _queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _sql[name] = sql
        return f

    return put


def _load() -> None:
    from . import aggregate_queries, market_queries, model_queries, scalar_queries, series_queries, source_queries, stream_queries  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict:
    _load()
    return dict(_sql)
