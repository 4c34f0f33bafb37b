"""The operators at work on the given tables, each with an independent SQL statement of its result."""

from __future__ import annotations

import importlib

MODULES = ("q_clean", "q_geometry", "q_response", "q_eligibility", "q_bridge", "q_model", "q_inference")


def load():
    """All registered queries and oracles."""
    from sparkmap.catalog import registry

    for m in MODULES:
        importlib.import_module(f"sparkmap.catalog.{m}")
    return registry.QUERIES, registry.ORACLES
