"""Queries of the library's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from graticula.functions import geometry, projections
from graticula.operators import clouds, dual, elements, elementwise, exchange, fvm, interpolation, mesh, partition, planar, polygons, reorder, rings, search, sparse, spectral, statistics, structured
from graticula.sources import grids, records
from graticula.streaming import windows

MODULES = (statistics, exchange, sparse, elementwise, search, partition, geometry, projections, grids, interpolation, structured, elements, clouds, mesh, dual, rings, reorder, polygons, planar, fvm, spectral, records, windows)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
