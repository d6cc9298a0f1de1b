"""Stand-in views and the registered queries."""

from __future__ import annotations

import importlib
import pkgutil


def load_queries():
    """Import every `*_queries` module of this package; return (queries, oracle SQL)."""
    from genemill.plans import registry

    for mod in pkgutil.iter_modules(__path__):
        if mod.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{mod.name}")
    return registry.QUERIES, registry.ORACLE
