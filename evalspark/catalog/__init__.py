"""All registered queries."""

from __future__ import annotations

import importlib

from evalspark.catalog.registry import Registry

FAMILIES = ["rules", "ledger", "runs", "evaluation", "failures", "compare", "profile", "querylog", "text", "stream"]


def load(families: list[str] | None = None) -> Registry:
    registry = Registry()
    for family in families or FAMILIES:
        importlib.import_module(f"evalspark.catalog.{family}").register(registry)
    return registry
