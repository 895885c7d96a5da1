"""Every query of the library with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "flagship_braking_balance"

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for the SQL of one that is made of it."""
    return _ORACLES[name]


def _load() -> None:
    """Import every module of queries once."""
    from importlib import import_module
    from pkgutil import iter_modules

    from kinegrid import plans

    for module in iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            import_module(f"kinegrid.plans.{module.name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
