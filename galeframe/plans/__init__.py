"""Registered queries."""

from importlib import import_module
from pathlib import Path


def all_queries():
    """Loads every q_* module and returns the registry."""
    for path in sorted(Path(__file__).parent.glob("q_*.py")):
        import_module(f"galeframe.plans.{path.stem}")
    return import_module("galeframe.plans.registry")
