"""All registered queries (importing the plan modules fills the registry)."""

from __future__ import annotations

import importlib

from ledgerlight.plans.registry import ORACLES, QUERIES

PLAN_MODULES = ("reports", "costs", "exports", "limits", "governance", "safety", "search", "transfer", "streams",
                "extension_queries")

for _name in PLAN_MODULES:
    importlib.import_module(f"ledgerlight.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
