"""Queries by theme; ``load()`` registers them all."""

from __future__ import annotations

import importlib
import pkgutil

from ledgerloom.catalog import registry


def load() -> tuple[dict, dict]:
    """All queries and the SQL of those that SQL can express."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
