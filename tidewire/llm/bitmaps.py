"""Bitmaps of fixed size over 64-bit hashes: cheap filters in front of exact joins.

A bitmap has one bit for each value of a hash's upper bits. It takes 2^bits / 8 bytes however many
hashes it stands for; with more of them it only lets more through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bitmap:
    """A packed bitmap, unpacked where it is first used."""

    def __init__(self, packed: np.ndarray, bits: int) -> None:
        self.packed, self.bits = packed, bits
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "bits": self.bits, "table": None}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of the hashes may be in the set."""
        if self.table is None:
            self.table = np.unpackbits(self.packed.view(np.uint8), bitorder="little").view(bool)
        return self.table[(hashes.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)]


def bitmap(hashed: DataFrame, bits: int) -> Bitmap:
    """The bitmap of the only column of ``hashed``; at most 2^bits / 64 numbers are fetched."""
    at = F.shiftrightunsigned(hashed[hashed.columns[0]], 64 - bits)
    filled = (
        hashed.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
        .toArrow()
    )
    packed = np.zeros((1 << bits) // 64, np.uint64)
    packed[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return Bitmap(packed, bits)
