"""Queries of the subpackage llm."""

from __future__ import annotations

import importlib

MODULES = ["split", "markup", "scans", "cutoff", "abuse", "names", "packing", "mixing"]


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"folioflow.llm.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
