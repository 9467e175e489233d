"""Query catalogue of the spatial engine: name -> DataFrame builder, name -> DuckDB SQL."""

from __future__ import annotations

from cairngrid.plans import compositions, intake, maps, stored, surfaces, tracks_plans  # noqa: F401
from cairngrid.plans.base import ORACLE, QUERIES

FLAGSHIP = "q10_mixture"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
