"""Queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from graticula.llm import decontaminate, lm, merkle, packing, pieces, quality, rans, secrets, sharding, simhash, suffixes, toolcalls, whitening

MODULES = (lm, pieces, packing, toolcalls, decontaminate, sharding, quality, simhash, rans, secrets, whitening, merkle, suffixes)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(m, "ORACLES", {}).items()}
