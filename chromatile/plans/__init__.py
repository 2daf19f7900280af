"""Registered queries, one per operator, with their check SQL."""

from __future__ import annotations

import importlib

MODULES = ("pixels", "statistics", "clusters", "tables", "spatial", "remap", "areas", "documents", "streams")


def load():
    """(queries, check SQL) with every plan module imported."""
    from chromatile.plans import registry

    for m in MODULES:
        importlib.import_module(f"chromatile.plans.{m}")
    return registry.QUERIES, registry.ORACLES
