"""Ordered computations over long groups, cut into blocks.

A window over (run, ORDER BY time) puts a whole run into one task. The operators
here split each group into blocks of ``span`` consecutive order values: one pass
totals the blocks, a window over the (few) totals carries state from block to
block, and the rows themselves are only ever ordered inside their block. A group
that holds a third of the data is then spread over as many tasks as it has blocks.
Only block totals meet in one task: five million of them for a third of 10^12 rows.

Keys and order are never NULL. The order column is a whole number and its values are spread out enough that one
block fits a task (for unique numbers, at most ``span`` rows).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.latency import whole_div
from tidewire.operators.lineage import stored

BLOCK = "_block"
DEFAULT_SPAN = 1 << 16
DENSE_ROWS = 1 << 20
_ROW_BITS = 33


@dataclass(frozen=True)
class Running:
    """A running aggregate of ``source``: ``kind`` is sum, min or max.

    With ``peers_only`` it covers just the rows of equal order value.
    """

    source: Column
    kind: str = "sum"
    peers_only: bool = False

    def over(self, value: Column) -> Column:
        aggregates: dict[str, Callable[[Column], Column]] = {
            "sum": F.sum, "min": F.min, "max": F.max,
        }
        return aggregates[self.kind](value)

    def combine(self, carried: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carried + local, local, carried)
        # least and greatest skip NULLs
        return F.least(carried, local) if self.kind == "min" else F.greatest(carried, local)


def with_block(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn(BLOCK, whole_div(F.col(order), span))


def _attach(blocked: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every block has its totals, so the join keeps all rows. Being an inner join it
    puts the same filters on both sides, which lets them share one shuffle."""
    return blocked.join(carry, [*keys, BLOCK])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, Running],
    *,
    span: int = DEFAULT_SPAN,
    descending: bool = False,
    with_ties: bool = False,
) -> DataFrame:
    """Add running aggregates, inclusive of the current row.

    ``descending`` runs from the largest order value down. ``with_ties`` lets rows
    of equal order see each other, as a RANGE frame does.
    """
    blocked = with_block(df, order, span).withColumns(
        {f"_v_{name}": item.source for name, item in columns.items()}
    )
    carried = {name: item for name, item in columns.items() if not item.peers_only}

    totals = blocked.groupBy(*keys, BLOCK).agg(
        *[item.over(F.col(f"_v_{name}")).alias(f"_t_{name}") for name, item in carried.items()]
    )
    direction = F.desc if descending else F.asc
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(direction(BLOCK))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        BLOCK,
        *[item.over(F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, item in carried.items()],
    )

    ordered = Window.partitionBy(*keys, BLOCK).orderBy(direction(order))
    peers = ordered.rangeBetween(0, 0)
    upto = (
        ordered.rangeBetween(Window.unboundedPreceding, 0)
        if with_ties
        else ordered.rowsBetween(Window.unboundedPreceding, 0)
    )

    def result(name: str, item: Running) -> Column:
        local = item.over(F.col(f"_v_{name}")).over(peers if item.peers_only else upto)
        return local if item.peers_only else item.combine(F.col(f"_c_{name}"), local)

    return _attach(blocked, carry, keys).select(
        *df.columns, *[result(name, item).alias(name) for name, item in columns.items()]
    )


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: dict[str, str],
    *,
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Add the value each column had in the previous row; NULL in the first row."""
    blocked = with_block(df, order, span)
    last = F.max_by(F.struct(*[F.col(c) for c in columns.values()]), F.col(order))
    totals = blocked.groupBy(*keys, BLOCK).agg(last.alias("_last"))
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = totals.select(*keys, BLOCK, F.lag("_last").over(by_block).alias("_before"))

    within = Window.partitionBy(*keys, BLOCK).orderBy(order)
    first = F.row_number().over(within) == 1
    joined = _attach(blocked, carry, keys)
    return joined.select(
        *df.columns,
        *[
            F.when(first, F.col(f"_before.{source}")).otherwise(F.lag(source).over(within)).alias(name)
            for name, source in columns.items()
        ],
    )


def dense_index(
    df: DataFrame, order: str, *, ties: Sequence[str] = (), name: str = "idx",
    total: str | None = None, span: int | None = None,
) -> DataFrame:
    """Number all rows 0..N-1 in the order of a column, then of ``ties``.

    The rows are cut by range into blocks of about ``span`` (DENSE_ROWS) rows, so there are as many blocks as the
    rows need, however far apart or close together their values lie, and however many are equal; each block is sorted and numbered in its task, and
    stored. The blocks' sizes, a few bytes each, give what is to be added. Rows of one block are numbered at once.

    ``total`` names an optional column for N.
    """
    count = df.count()
    blocks = -(-count // (span or DENSE_ROWS))
    by = [order, *ties, "_given"]
    given = df.withColumn("_given", F.monotonically_increasing_id())  # cuts rows that are equal so far
    ordered = given.repartitionByRange(blocks, *by) if blocks > 1 else given.repartition(1)
    row = F.monotonically_increasing_id()  # the block's number, and the row's place in it
    numbered = ordered.sortWithinPartitions(*by).drop("_given").withColumn("_row", row)
    offset = F.lit(0)
    if blocks > 1:
        numbered = stored(numbered, "numbered")
        numbered = numbered.withColumn(BLOCK, F.shiftrightunsigned("_row", _ROW_BITS))
        sizes = numbered.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
        numbered, offset = _attach(numbered, offsets, []), F.col("_offset")
    place = offset + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    extra = [F.lit(count).cast("bigint").alias(total)] if total else []
    return numbered.select(*df.columns, place.cast("bigint").alias(name), *extra)
