"""Registered queries, one module per inventory block."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("block_"):
            importlib.import_module(f"{__name__}.{m.name}")
