"""Configuration values: target rates, properties text, defaults, transaction settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.binding import once

INT_MAX = 2**31 - 1
PROBE_START_RATE = 10_000.0
LOWEST_RATE = 1.0

# Key modes, the first one is the default.
KEY_MODES = ("NO_KEY", "KEY_ROUND_ROBIN", "RANDOM_NANO")

# Events per transaction when the configuration does not say.
EVENTS_PER_TRANSACTION = {"kafka": 100, "stamped-stream": 1}


def resolve_target_rate(producer_rate: Column) -> Column:
    """Configured rate as a target: unlimited, as given, or the start of a search."""
    unlimited = (producer_rate == -1) | (producer_rate >= F.lit(INT_MAX))
    return (
        F.when(unlimited, F.lit(float("inf")))
        .when(producer_rate > 0, producer_rate.cast("double"))
        .otherwise(F.lit(PROBE_START_RATE))
    )


def rate_per_worker(target: Column, producer_workers: Column) -> Column:
    return target / producer_workers


def adjusted_rate(target: Column) -> Column:
    """Rate after a later adjustment, which never goes below one message per second."""
    return F.greatest(target, F.lit(LOWEST_RATE))


def parse_properties(text: Column) -> Column:
    """``key=value`` lines as a map; comments and blanks dropped, the last repeat wins."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: F.trim(line))
    kept = F.reverse(F.filter(lines, lambda line: (line != "") & ~line.rlike("^[#!]")))

    def to_map(entries: Column) -> Column:
        keys = F.transform(entries, lambda line: F.regexp_extract(line, r"^([^=:\s]+)", 1))
        values = F.transform(
            entries, lambda line: F.regexp_extract(line, r"^[^=:\s]+\s*[=:]?\s*(.*)$", 1)
        )

        def last_values(keys: Column) -> Column:
            distinct = F.array_distinct(keys)
            found = F.transform(
                distinct, lambda k: F.element_at(values, F.array_position(keys, k).cast("int"))
            )
            return F.map_from_arrays(distinct, found)

        return once(keys, last_values)

    return once(kept, to_map)


def merge_properties(common: Column, specific: Column) -> Column:
    """Union of two maps in which ``specific`` overrides ``common``."""

    def merged(own: Column) -> Column:
        overridden = F.map_keys(own)
        kept = F.map_filter(common, lambda k, _: ~F.array_contains(overridden, k))
        return F.map_concat(kept, own)

    return once(specific, merged)


def properties_text(props: Column) -> Column:
    """Canonical one-line form of a properties map, sorted by key."""
    entries = F.array_sort(F.map_entries(props))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(shown, ";")


def enum_default(mode: Column) -> Column:
    return F.when(mode.isin(*KEY_MODES), mode).otherwise(F.lit(KEY_MODES[0]))


def transaction_enabled(props: Column) -> Column:
    flag = F.lower(F.try_element_at(props, F.lit("enableTransaction")))
    return F.coalesce(flag == "true", F.lit(False))


def events_per_transaction(system: Column, props: Column) -> Column:
    """Batch size of a transactional producer; a misspelt setting is simply unknown."""
    default = F.lit(EVENTS_PER_TRANSACTION["stamped-stream"])
    default = F.when(system == "kafka", F.lit(EVENTS_PER_TRANSACTION["kafka"])).otherwise(default)
    given = F.try_element_at(props, F.lit("eventsPerTransaction")).try_cast("int")
    return F.coalesce(given, default)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))
