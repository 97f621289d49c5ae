"""Every registered query and its SQL counterpart."""

import importlib

from tabwright.queries.registry import QUERIES, SQL

MODULES = ["edits", "profiles", "cleaning", "evaluation", "monitoring", "operations", "texts", "learning", "storage"]

for _name in MODULES:
    importlib.import_module(f"{__name__}.{_name}")

__all__ = ["QUERIES", "SQL"]
