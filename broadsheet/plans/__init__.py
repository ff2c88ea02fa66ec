"""The registered queries, one module per operator family, each with its SQL oracle."""

from __future__ import annotations

import importlib

FAMILIES = ("extraction", "classification", "heat", "listings")


def registered() -> dict[str, tuple]:
    """name -> (query, oracle SQL or None)."""
    found: dict[str, tuple] = {}
    for family in FAMILIES:
        found |= importlib.import_module(f"{__name__}.{family}").QUERIES
    return found
