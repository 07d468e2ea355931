"""Named queries over the supplied tables, each module with QUERIES and ORACLE (the same in SQL)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["references", "dataset", "geometry", "retrieval", "texts", "matching", "calibrated", "sampling", "objectives", "provenance", "streams", "more"]


def core_queries() -> list:
    return [import_module(f"setlens.plans.{name}") for name in MODULES]
