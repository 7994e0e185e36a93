"""Every registered query of the reference's own operators, with its DuckDB twin."""

from __future__ import annotations

import importlib

from lodestone.plans.registry import ORACLE_SQL, QUERIES

for _family in ("retrieval", "routes", "graphs", "evaluation", "filtering", "texts", "answers", "streams"):
    importlib.import_module(f"lodestone.plans.{_family}")

__all__ = ["ORACLE_SQL", "QUERIES"]
