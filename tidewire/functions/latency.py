"""Latency arithmetic: clamping, unit changes, histogram buckets, percentile axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest latency recorded, in microseconds (60 s and 12 h).
PUBLISH_MAX_US = 60_000_000
E2E_MAX_US = 43_200_000_000

# Five significant digits: unit resolution up to 2^18, then one bit less per doubling.
EXACT_BITS = 18
TOP_BITS = 36


def whole_div(dividend: Column, divisor: Column | int) -> Column:
    """Whole-number division, exact for all 64-bit values."""
    return F.call_function("div", dividend, divisor if isinstance(divisor, Column) else F.lit(divisor))


def _clamp(value: Column, upper: int) -> Column:
    bounded = F.least(F.greatest(value, F.lit(0).cast("bigint")), F.lit(upper).cast("bigint"))
    return F.when(value.isNotNull(), bounded)


def publish_latency_us(send_ns: Column, ack_ns: Column) -> Column:
    return _clamp(whole_div(ack_ns - send_ns, 1000), PUBLISH_MAX_US)


def e2e_latency_us(publish_ms: Column, receive_ms: Column) -> Column:
    """Millisecond clocks on both ends; an unknown publish time stays NULL."""
    return _clamp((receive_ms - publish_ms) * F.lit(1000), E2E_MAX_US)


def us_to_ms(us: Column) -> Column:
    return us / F.lit(1000.0)


def to_mb_per_s(n_bytes: Column, seconds: Column | float) -> Column:
    """Decimal megabytes per second."""
    return n_bytes / (F.lit(seconds) if not isinstance(seconds, Column) else seconds) / F.lit(1e6)


def hdr_bucket(us: Column) -> Column:
    """Highest value that shares a histogram bucket with ``us``.

    Below 2^18 each microsecond has its own bucket. In [2^(17+i), 2^(18+i)) the
    unit is 2^i, so the top of the bucket is the value with its low i bits set.
    A plain comparison chain keeps this in generated code without string work.
    """
    bucket = F.when(us < F.lit(1 << EXACT_BITS), us)
    for i in range(1, TOP_BITS - EXACT_BITS + 1):
        low_bits = F.lit((1 << i) - 1).cast("bigint")
        bucket = bucket.when(us < F.lit(1 << (EXACT_BITS + i)), us.bitwiseOR(low_bits))
    unit_bits = F.length(F.bin(us)) - F.lit(EXACT_BITS)
    low_bits = F.call_function("shiftleft", F.lit(1).cast("bigint"), unit_bits) - F.lit(1)
    return bucket.when(us.isNotNull(), us.bitwiseOR(low_bits))


def percentile_axis(percentile: Column) -> Column:
    """Chart position of a percentile: one unit per additional nine."""
    return F.log10(F.lit(100.0) / (F.lit(100.0) - percentile))


def percentile_label(axis: Column) -> Column:
    return F.lit(100.0) - F.lit(100.0) / F.pow(F.lit(10.0), axis)
