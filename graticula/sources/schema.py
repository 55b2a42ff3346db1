"""Canonical schemas: nodes, cells, fields, weights, distributions, spectra."""

from __future__ import annotations

FIELD_KEYS = ("gidx", "lev", "var")
NODES = "gidx long, part int, x double, y double, lon double, lat double, ghost boolean, flags int, halo int"
CELLS = "cell long, part int, halo int, flags int, nodes array<long>"
FIELD = "gidx long, lev int, var int, value double"
WEIGHTS = "row long, col long, w double"
DISTRIBUTION = "gidx long, part int"
SPECTRA = "m int, n int, part int, value double"
