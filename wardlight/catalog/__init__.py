"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from wardlight.catalog.registry import Registry


def build_registry() -> Registry:
    """All registered queries."""
    import importlib

    registry = Registry()
    for name in ("series", "designs", "shapes", "fits", "stages", "wards", "scalars"):
        importlib.import_module(f"wardlight.catalog.{name}").register(registry)
    return registry
