"""All registered queries by name."""

from importlib import import_module

AREAS = ["triage", "assets", "rules", "mapping", "classify", "compliance", "graph", "snapshots",
         "repositories", "streaming"]


def all_queries() -> dict:
    out = {}
    for area in AREAS:
        out.update(import_module(f"threatloom.plans.registry_{area}").QUERIES)
    return out


def all_checks() -> dict:
    out = {}
    for area in AREAS:
        out.update(import_module(f"checks.{area}").SQL)
    return out
