"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

AREAS = ("ops", "tickets", "retrieval", "models", "threads")


def queries() -> dict:
    found = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}").QUERIES)
    return found


def oracles() -> dict:
    found = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}").ORACLES)
    return found
