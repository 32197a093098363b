"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import loomspan.plans as _plans

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in sorted(m.name for m in pkgutil.iter_modules(_plans.__path__) if m.name not in ("registry", "tables")):
    _module = importlib.import_module(f"loomspan.plans.{_m}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
