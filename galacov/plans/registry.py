"""Names of queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def _load() -> None:
    from galacov.plans import calibration_queries, catalog_queries, matrix_queries, pair_queries, sampling_queries, source_queries, term_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark, sf_dir: str):
    return queries()["xi_landy_szalay"](spark, sf_dir)
