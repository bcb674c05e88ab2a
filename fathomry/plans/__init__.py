"""The core's named queries, by subject."""

from __future__ import annotations

import importlib

SUBJECTS = ("integrity", "corpus", "retrieval", "quality")


def core_registries() -> list:
    return [importlib.import_module(f"fathomry.plans.{name}").registry for name in SUBJECTS]
