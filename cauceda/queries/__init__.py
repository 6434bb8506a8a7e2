"""Queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from cauceda.queries import analytics, governed, jobs, landing, scalars, semantic

MODULES = (analytics, scalars, semantic, landing, governed, jobs)


def queries():
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
