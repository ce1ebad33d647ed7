"""Fixture views, registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["scalars", "filters", "joins", "aggregates", "windows", "topk", "sets", "vectors", "ranking", "profiles", "upkeep", "feeds", "streams"]


def _load():
    from modiste.workload import fixtures

    for name in MODULES:
        try:
            importlib.import_module(f"modiste.workload.{name}")
        except ModuleNotFoundError as ex:
            if ex.name != f"modiste.workload.{name}":
                raise
    return fixtures


def all_queries():
    return dict(_load().QUERIES)


def all_twins():
    return dict(_load().ORACLES)
