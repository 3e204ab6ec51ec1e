"""All queries of the core, with their SQL."""

from __future__ import annotations

import importlib

from fabula.plans.registry import Query

MODULES = ["corpus", "constraints", "records", "tokens", "curves", "serving", "sampling", "streams", "files"]


def _registries():
    return [importlib.import_module(f"fabula.plans.{m}").registry for m in MODULES]


def queries() -> dict[str, Query]:
    return {name: f for r in _registries() for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for r in _registries() for name, s in r.sql.items()}
