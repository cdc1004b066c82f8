"""Registered queries over the given tables, each with the SQL that must return the same rows."""

from . import cleaning, models, profiling, splits, transforms

MODULES = (cleaning, profiling, transforms, splits, models)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
