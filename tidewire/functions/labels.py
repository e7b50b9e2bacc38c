"""Label selectors and legends for metric series."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(labels: Column, name: str) -> Column:
    """Value of a label; a missing label equals the empty string."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def label_match(labels: Column, name: str, op: str, value: str) -> Column:
    """Selector ``name op value`` with op one of ``= != =~ !~``; regexes match whole values."""
    found = label(labels, name)
    anchored = f"^(?:{value})$"
    if op == "=":
        return found == value
    if op == "!=":
        return found != value
    if op == "=~":
        return found.rlike(anchored)
    if op == "!~":
        return ~found.rlike(anchored)
    raise ValueError(f"unknown selector operator {op!r}")


def series_label(template: str, labels: Column) -> Column:
    """Legend text: ``{{ name }}`` in the template stands for a label value."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    pieces = [F.lit(p) if i % 2 == 0 else label(labels, p) for i, p in enumerate(parts)]
    return F.concat(*pieces)


def series_id(name: Column, labels: Column) -> Column:
    """One string per (metric, label set), independent of label order.

    Backslashes and quotes in values are escaped, so different sets have different strings.
    """

    def escaped(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    entries = F.array_sort(F.map_entries(labels))
    shown = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))
    )
    return F.concat(name, F.lit("{"), F.array_join(shown, ","), F.lit("}"))
