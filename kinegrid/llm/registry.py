"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from kinegrid.llm import op01_mix, op02_repeats, op03_topk, op04_chat, op05_html, op06_minhash, op07_decontaminate, op08_language, op09_lines, op10_tokens, op11_audit, op12_search, op13_toxicity
from kinegrid.session import ship

_MODULES = (op01_mix, op02_repeats, op03_topk, op04_chat, op05_html, op06_minhash, op07_decontaminate, op08_language, op09_lines, op10_tokens, op11_audit, op12_search, op13_toxicity)


def _shipped(query: Callable) -> Callable:
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable]:
    return {k: _shipped(f) for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in getattr(m, "ORACLE_SQL", {}).items()}
