"""A Bloom filter over 64-bit keys, built by Spark and probed with numpy.

Its size follows the number of keys up to ``BITS`` and never goes beyond, so it may be
broadcast; when it fills up it only filters less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most bits (8 MB), and how many a key gets up to there.
BITS, PER_KEY = 1 << 26, 16
PROBES = 4


def build(keys: DataFrame, key: str, bits: int = BITS, per_key: int = PER_KEY) -> np.ndarray:
    """The filter's words over column ``key`` (long), of ``bits`` bits at most."""
    wanted = per_key * max(keys.count(), 1)
    size = min(bits, max(1 << 12, 1 << int(wanted - 1).bit_length()))
    low, high = F.col(key).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(key), 32)
    at = [(low + F.lit(j) * high).bitwiseAND(F.lit(size - 1)) for j in range(PROBES)]
    cells = keys.select(F.explode(F.array(*at)).alias("at"))
    cell = F.shiftrightunsigned(F.col("at"), 6).cast("int")
    bit = F.expr("shiftleft(1L, int(at & 63))")
    # one row for each word of the filter at most
    table = cells.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[table["cell"].to_numpy(np.int64)] = table["bit"].to_numpy(np.int64)
    return out.view(np.uint64)


def holds(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of ``keys`` (uint64) may be in the filter.  A key that the first probe rules out
    costs no more."""
    mask = np.uint64(len(words) * 64 - 1)
    out = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for j in range(PROBES):
        k = keys[left]
        at = ((k & np.uint64(0xFFFFFFFF)) + np.uint64(j) * (k >> np.uint64(32))) & mask
        left = left[(words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    out[left] = True
    return out
