"""Registered queries with their SQL twins, one module per operator family."""

from importlib import import_module

MODULES = ("sources", "scalars", "filters", "joins", "aggregates", "ordering", "vectors", "clustering", "profiles", "plans")


def load_checks() -> dict:
    from checks.base import REGISTRY

    for name in MODULES:
        import_module(f"checks.{name}")
    return REGISTRY
