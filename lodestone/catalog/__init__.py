"""Registered queries and their SQL statements, one module per section."""

from __future__ import annotations

import importlib
import pkgutil

from lodestone.catalog import registry


def load_all():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        if m.startswith("section_"):
            importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES
