"""Registered queries, one module per operator family."""

from importlib import import_module

FAMILIES = ["scoring", "headers", "auth", "content", "network", "domain", "footprint",
            "graph", "views", "audit", "ingest", "streams"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
