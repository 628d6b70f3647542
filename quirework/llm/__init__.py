"""Operators for training data, with their queries and SQL. Nothing else in the library imports this."""

from __future__ import annotations

import importlib

MODULES = ("spelling", "frequency", "clusters", "cooccurrence", "neardup", "packing", "mixing", "reading")


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]
