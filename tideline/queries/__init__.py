"""Registered queries over the driver tables, each with its SQL check where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("derived", "groups", "days", "removal", "archive", "health", "jobs", "rules", "streams")


def load() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        import_module(f"tideline.queries.{module}")
