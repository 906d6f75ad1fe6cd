"""All queries of the core."""

from __future__ import annotations

import importlib

MODULES = [f"folioflow.plans.{m}_queries" for m in ("incremental", "structure", "term", "state", "page", "document")]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).ORACLE.items()}
