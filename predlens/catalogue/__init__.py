"""Registered queries: each reads the given tables; most have an independent SQL counterpart."""

from importlib import import_module

FAMILIES = ["batting", "games", "statistics", "profiles", "models", "machines"]


def all_queries():
    return dict(_registry().QUERIES)


def check_sql():
    return dict(_registry().CHECK_SQL)


def _registry():
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
    return import_module(f"{__name__}.registry")
