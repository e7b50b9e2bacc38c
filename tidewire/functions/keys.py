"""Message key strategies, each a column expression over a dense sequence number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.naming import KEY_BYTES, random_token

KEY_COUNT = 10_000


def key_none(producer: Column, seq: Column) -> Column:
    return F.lit(None).cast("string")


def round_robin_index(seq: Column) -> Column:
    """Index of the key for the seq-th message: counting starts at 1 and wraps to 0."""
    return F.pmod(seq + F.lit(1), F.lit(KEY_COUNT))


def random_index(producer: Column, seq: Column, seed: int = 0) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), producer.cast("string"), seq.cast("string"))
    drawn = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return F.pmod(drawn, F.lit(KEY_COUNT))


def pool_key(index: Column, seed: str = "keys") -> Column:
    """The index-th key of the pool, computed in place so that no pool has to be joined."""
    return random_token(seed, index, KEY_BYTES)


def key_round_robin(producer: Column, seq: Column) -> Column:
    return pool_key(round_robin_index(seq))


def key_random(producer: Column, seq: Column) -> Column:
    return pool_key(random_index(producer, seq))


KeyStrategy = Callable[[Column, Column], Column]

_STRATEGIES: dict[str, KeyStrategy] = {
    "NO_KEY": key_none,
    "KEY_ROUND_ROBIN": key_round_robin,
    "RANDOM_NANO": key_random,
}


def register_key_strategy(name: str, strategy: KeyStrategy) -> None:
    _STRATEGIES[name] = strategy


def key_for(mode: str, producer: Column, seq: Column) -> Column:
    """Key column of a registered strategy; unknown names fall back to no key."""
    return _STRATEGIES.get(mode, key_none)(producer, seq)
