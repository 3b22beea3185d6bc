"""Registered queries, by area."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """(queries, oracles) after importing every plan module."""
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if mod.endswith("_queries"):
            importlib.import_module(f"{__name__}.{mod}")
    from tremor.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
