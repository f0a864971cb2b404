"""Compositions of the operators over the given tables."""

from importlib import import_module

GROUPS = ("corpus", "texts", "modelling", "scoring", "web", "ledgers", "streams")


def load_all() -> None:
    """Import every group of queries, which registers them."""
    for group in GROUPS:
        import_module(f"newsmill.plans.{group}")
