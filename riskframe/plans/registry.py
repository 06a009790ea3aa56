"""All registered queries: name -> (spark callable, oracle SQL or None)."""

from __future__ import annotations

import importlib

PLAN_MODULES = ["scoring", "evaluation", "monitoring", "linking", "quality", "text", "ordering", "ingest", "streams", "learning", "serving"]


def all_queries() -> dict:
    out = {}
    for m in PLAN_MODULES:
        mod = importlib.import_module(f"riskframe.plans.{m}")
        for name, pair in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = pair
    return out
