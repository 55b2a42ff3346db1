"""Bitmaps of a fixed size by which tasks drop most hashes that are not in a table; a join decides about the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leading bits of a hash that are looked up: the bitmap has 2 ** BITS bits, 2 MB.
BITS = 24


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Which leading bits occur, as 2 ** bits flags: at most so many bits reach the driver, whatever the number of hashes."""
    at = F.shiftrightunsigned(column, 64 - bits) + 1  # buckets are numbered from 1 for positions from 1 on
    found = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("flags")).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in found:
        first = (r.bucket - 1) * len(r.flags)
        out[first : first + len(r.flags)] = np.frombuffer(bytes(r.flags), np.uint8)
    return out


def passing(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The numbers of the hashes whose flag is set."""
    bits = len(flags).bit_length() + 2
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(flags[at >> 3] >> (at & 7).astype(np.uint8) & 1)
