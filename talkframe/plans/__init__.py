"""Plans over a corpus, and the register of queries."""

from __future__ import annotations


def load_queries():
    """Import all query modules and give the register."""
    from importlib import import_module

    for family in ("files", "segments", "windows", "catalogue", "text", "live"):
        import_module(f"talkframe.plans.queries_{family}")
    return import_module("talkframe.plans.registry")
