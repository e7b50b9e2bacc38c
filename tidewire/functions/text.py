"""Fixed-width numbers and the report lines built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.binding import once

# Minimum widths of rates, throughputs and latencies in report lines.
RATE_WIDTH = 7
THROUGHPUT_WIDTH = 4
LATENCY_WIDTH = 4

_SPLITTER = 134217729.0  # 2^27 + 1, halves the significand of a double
_LARGEST_EXACT = float(1 << 51)


def _tenths(magnitude: Column) -> Column:
    """Nearest whole number of tenths of a non-negative double, ties to even.

    The tie is judged on the exact binary value: ``x * 10`` is split into the
    rounded product and its exact error, which decides apparent halves.
    """
    scaled = magnitude * F.lit(10.0)
    spread = magnitude * F.lit(_SPLITTER)
    high = spread - (spread - magnitude)
    low = magnitude - high
    error = (high * F.lit(10.0) - scaled) + low * F.lit(10.0)
    whole = F.floor(scaled)
    part = scaled - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return whole + F.when(up, F.lit(1)).otherwise(F.lit(0))


def _with_one_decimal(number: Column) -> Column:
    magnitude = F.abs(number)
    negative = (number < 0) | (number.cast("string") == "-0.0")
    sign = F.when(negative, F.lit("-")).otherwise(F.lit(""))
    digits = once(
        _tenths(magnitude),
        lambda tenths: F.concat(
            F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")
        ),
    )
    return (
        F.when(F.isnan(number), F.lit("NaN"))
        .when(magnitude == F.lit(float("inf")), F.concat(sign, F.lit("∞")))
        .when(magnitude >= F.lit(_LARGEST_EXACT), F.format_string("%.1f", number))
        .otherwise(F.concat(sign, digits))
    )


def one_decimal(number: Column) -> Column:
    """Number with exactly one decimal, rounded half-even on its exact value."""
    return once(number.cast("double"), _with_one_decimal)


def pad_number(number: Column, width: int) -> Column:
    """One decimal, padded with blanks on the left and never cut."""

    def padded(shown: Column) -> Column:
        blanks = F.greatest(F.lit(width) - F.length(shown), F.lit(0))
        return F.concat(F.repeat(F.lit(" "), blanks), shown)

    return once(one_decimal(number), padded)


def rate_parts(
    publish_rate: Column, publish_mb: Column, consume_rate: Column, consume_mb: Column, width: int
) -> list[Column]:
    return [
        F.lit("Pub rate "), pad_number(publish_rate, width), F.lit(" msg/s / "),
        pad_number(publish_mb, THROUGHPUT_WIDTH), F.lit(" MB/s | Cons rate "),
        pad_number(consume_rate, width), F.lit(" msg/s / "),
        pad_number(consume_mb, THROUGHPUT_WIDTH), F.lit(" MB/s"),
    ]


def period_line(
    publish_rate: Column,
    publish_mb: Column,
    consume_rate: Column,
    consume_mb: Column,
    backlog: Column,
    publish_ms: dict[str, Column],
) -> Column:
    """Progress line of one reporting period; ``publish_ms`` maps statistic to milliseconds."""
    rates = rate_parts(publish_rate, publish_mb, consume_rate, consume_mb, RATE_WIDTH)
    parts = [
        *rates, F.lit(" | Backlog: "), backlog.cast("string"), F.lit(" msg | Pub Latency (ms)"),
    ]
    return F.concat(*parts, _latency_part(publish_ms))


def summary_line(
    publish_rate: Column, publish_mb: Column, consume_rate: Column, consume_mb: Column
) -> Column:
    """Line with the mean rates of a whole run."""
    rates = rate_parts(publish_rate, publish_mb, consume_rate, consume_mb, THROUGHPUT_WIDTH)
    return F.concat(F.lit("----- Aggregated "), *rates)


def latency_line(title: str, stats_ms: dict[str, Column]) -> Column:
    return F.concat(F.lit(f"{title} (ms)"), _latency_part(stats_ms))


def _latency_part(stats_ms: dict[str, Column]) -> Column:
    shown = [
        F.concat(F.lit(f"{name}: "), pad_number(value, LATENCY_WIDTH))
        for name, value in stats_ms.items()
    ]
    return F.concat(F.lit(" "), F.concat_ws(" - ", *shown))
