"""Registered queries. ``load`` imports every query module once."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = (
    "triage_queries",
    "lifecycle_queries",
    "corpus_queries",
    "retrieval_queries",
    "evaluation_queries",
    "reporting_queries",
    "stream_queries",
)


def load() -> ModuleType:
    for name in MODULES:
        import_module(f"postroom.plans.{name}")
    return import_module("postroom.plans.registry")
