"""The registered queries, one module for each family of operators, each with its SQL."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def reference_queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def reference_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.ORACLES.items()}
