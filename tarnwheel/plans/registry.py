"""All queries of the core, by name."""

from __future__ import annotations

from . import design, problems, relations, run_metrics, services, systems

MODULES = [problems, run_metrics, design, relations, systems, services]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
