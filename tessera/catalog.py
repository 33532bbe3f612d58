"""All queries of the engine by name, and their SQL forms."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pixel_queries", "text_queries", "raster_queries", "colour_queries", "work_queries", "feature_queries")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"tessera.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in import_module(f"tessera.plans.{m}").SQL.items()}
