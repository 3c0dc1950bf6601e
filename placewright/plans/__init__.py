"""Registered queries: one per operator of the inventory, bound to the given tables."""

from importlib import import_module

SECTIONS = ["scalars", "reads", "checks", "guards", "outputs", "rebuilds", "reconciles", "intakes"]


def load():
    for section in SECTIONS:
        import_module(f"{__name__}.{section}")
    return import_module(f"{__name__}.registry")
