"""Importing this module registers every query."""

import importlib
import pkgutil

from tidepanel import plans
from tidepanel.plans.registry import QUERIES, STATEMENTS

for _module in pkgutil.iter_modules(plans.__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"tidepanel.plans.{_module.name}")

__all__ = ["QUERIES", "STATEMENTS"]
