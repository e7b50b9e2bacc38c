"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time per row, however often
    ``use`` mentions it; keeps the expression from growing with every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)
