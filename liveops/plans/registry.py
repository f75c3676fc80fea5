"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from liveops.plans.fixtures import VIEWS, Tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _with(names: list[str]) -> str:
    """Common table expressions for ``names`` and all they refer to, dependencies first."""
    done: dict[str, str] = {}

    def add(name):
        if name not in done:
            deps, body = VIEWS[name]
            for dep in deps:
                add(dep)
            done[name] = f"{name} AS ({body})"

    for name in names:
        add(name)
    return "WITH " + ",\n".join(done.values()) + "\n" if done else ""


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``views`` are fixtures the SQL uses."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            # SQL that adds tables of its own to the list starts with a comma.
            ORACLES[name] = _with(views.split()) + sql.lstrip()
        return fn

    return register
