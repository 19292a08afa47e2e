"""All queries of the engine's own operators and their SQL twins."""

from __future__ import annotations

import importlib

PLANS = ("underwriting", "reports", "workflow", "portfolio", "pages", "review", "periods", "audit", "recompute", "registry", "streams", "policy", "consensus", "scenarios")


def _all(name: str) -> dict:
    return {k: v for plan in PLANS for k, v in getattr(importlib.import_module(f"fintally.plans.{plan}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
