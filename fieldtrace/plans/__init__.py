"""Registered queries (``queries_*`` modules) and the sport plans built from the operators."""

from __future__ import annotations

import importlib
import pkgutil


def load_queries():
    """Import every ``queries_*`` module and return (queries, oracles)."""
    from fieldtrace.plans import registry

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("queries_")):
        importlib.import_module(f"{__name__}.{mod}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
