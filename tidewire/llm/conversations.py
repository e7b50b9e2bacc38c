"""Conversation repair: cheapest edits to system? (user assistant)*, by Four-Russians block tables.

A row is one of nine symbols: its role's initial (s, u, a or another), truncated or not, or a row that has to
go (blank, or role and text seen earlier). A plan has four states: nothing yet, after the system row, after a user,
after an assistant. The cost-to-go of the four states, less its least entry, takes few different values; they are
numbered, and for every number and every block of BLOCK symbols a table built once per worker says
which number stands before the block. A conversation is worked through from its end, one look-up a block. Then each
block is expanded backward from the number at its end, and edits are chosen forward, always the first in ASCII order
among those that are still cheapest: so ties give the least audit.

Rows are sorted over the whole table by range and cut into segments of at most SEGMENT rows, so that a
conversation with a third of all rows lies in many tasks. A segment is a small function (number at its end to number at its
start; state before to state after); those of long conversations are chained, and every segment is then edited by itself.
Rows that are equal in everything come together before they are sorted.

Edits: K keeps a row (0), R gives it the role user or assistant (2), D deletes it (3), I inserts an empty user or assistant
row (2); a truncated row that stays adds 1.

Defined results: nulls are one space; a null conversation is one of its own; rows are taken by turn (nulls first), role and
text. A conversation without rows has an empty audit and no rows. Roles count by their first character.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import BATCH_ROWS, small_batches
from tidewire.operators.lineage import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK = 4
SEGMENT = 4096
SEGMENT_BYTES = 1 << 20

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: twice the place of the initial in "sua" or 3, plus 1 if truncated; then a row that goes; then no row at all.
GONE, NONE = 8, 9
SYMBOLS = 10
_SPACES = " \t\n\x0b\x0c\r"
_LEGAL = ("su", "ua", "au")

_turn = "struct<role: string, text: string>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_counts = ", ".join(f"{c} bigint" for c in _COUNTS)
_SEGMENT_FIELDS = f"segment bigint, symbols binary, turns array<{_turn}>, first string, last string, {_counts}"
_EDITED_FIELDS = f"segment bigint, {_counts}, whole boolean, audit string, cost bigint, sha256 string, turns array<{_turn}>"
_turn_type = pa.struct([("role", pa.string()), ("text", pa.string())])


def _next_role(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _steps(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """The edits that take a row in a state, in ASCII order: letter, cost, next state."""
    steps = [("D", DELETE, state)]
    if symbol == GONE:
        return steps
    initial, extra = symbol // 2 + 1, TRUNCATED * (symbol % 2)
    if (initial == SYSTEM and state == START) or initial == _next_role(state):
        steps.append(("K", KEEP + extra, initial))
    return [*steps, ("R", REROLE + extra, _next_role(state))]


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs-to-go when rows may also be inserted here."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_next_role(s)]) for s, c in enumerate(costs)]
    return tuple(costs)


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return _with_inserts([min(cost + after[to] for _, cost, to in _steps(symbol, s)) for s in range(4)])


class Tables:
    """Numbered cost vectors, the block table over them, and the chosen edits of every row.

    ``back[v][symbol]`` is the number before a row, ``blocks[v][block]`` the one before a
    block, where ``v`` stands behind it. ``choice[v][symbol][state]`` has the audit letters, the
    roles inserted before the row, the role it gets (None: its own; "": it goes), the state after it and the cost.
    """

    def __init__(self) -> None:
        never = 99
        vectors = [_with_inserts([0, never, never, 0])]
        numbers = {vectors[0]: 0}
        back: list[list[int]] = []
        for after in vectors:  # grows as new vectors are found
            row = []
            for symbol in range(GONE + 1):
                costs = _before(symbol, after)
                least = min(costs)
                vector = tuple(c - least for c in costs)
                if vector not in numbers:
                    numbers[vector] = len(vectors)
                    vectors.append(vector)
                row.append(numbers[vector])
            back.append([*row, len(back)])
        self.back = [bytes(row) for row in back]
        step = np.array(back, np.uint8)
        symbols = np.arange(SYMBOLS**BLOCK)
        blocks = np.repeat(np.arange(len(vectors), dtype=np.uint8)[:, None], len(symbols), axis=1)
        for place in range(BLOCK):  # the last symbol of a block comes first
            blocks = step[blocks, symbols // SYMBOLS**place % SYMBOLS]
        self.blocks = [row.tobytes() for row in blocks]
        self.choice = [[[self._choose(v, y, s) for s in range(4)] for y in range(GONE + 1)] for v in vectors]
        self.at_end = [self._inserts(s) for s in range(4)]

    @staticmethod
    def _inserts(state: int) -> tuple[str, list[str], int]:
        roles: list[str] = []
        while state in (SYSTEM, USER):
            state = _next_role(state)
            roles.append(NAMES[state])
        return "I" * len(roles), roles, state

    @staticmethod
    def _choose(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, list[str], str | None, int, int]:
        costs, roles, spent = _before(symbol, after), [], 0
        while True:
            best = [x for x in _steps(symbol, state) if x[1] + after[x[2]] == costs[state]]
            if costs[state] == INSERT + costs[_next_role(state)] and not any(x[0] < "I" for x in best):
                state = _next_role(state)
                roles.append(NAMES[state])
                spent += INSERT
                continue
            letter, cost, to = best[0]
            return "I" * len(roles) + letter, roles, {"D": "", "K": None, "R": NAMES.get(to)}[letter], to, spent + cost


@functools.cache
def tables() -> Tables:
    return Tables()


def blocks_of(symbols: bytes) -> list[int]:
    """The numbers of the blocks of some rows; the last one is filled up with no rows."""
    filled = np.frombuffer(symbols.ljust(-(-len(symbols) // BLOCK) * BLOCK, bytes([NONE])), np.uint8).reshape(-1, BLOCK)
    return (filled @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).tolist()


def vectors_behind(blocks: list[int], last: int = 0) -> list[int]:
    """The vector before the first block and behind each one, by one look-up a block, for the vector behind all of them."""
    behind, table = [last], tables().blocks
    for block in reversed(blocks):
        behind.append(table[behind[-1]][block])
    return behind[::-1]


def choices(symbols: bytes, behind: list[int], state: int = START) -> Iterator[tuple[str, list[str], str | None, int, int]]:
    """What to do with each row: blocks expanded backward, edits chosen forward."""
    back, choice = tables().back, tables().choice
    for k, at in enumerate(range(0, len(symbols), BLOCK)):
        own = symbols[at : at + BLOCK]
        after = [behind[k + 1]]
        for symbol in reversed(own[1:]):
            after.append(back[after[-1]][symbol])
        for symbol, vector in zip(own, reversed(after), strict=True):
            made = choice[vector][symbol][state]
            state = made[3]
            yield made


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, copies) with one of five faults in a quarter of them, by a hash of conversation and turn.

    0 drops a row (0 copies), 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it the user's.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    fault = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    return turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(spaced[2]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(spaced[3], ".!?", "")).otherwise(spaced[3]).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _faulty(rows: DataFrame) -> DataFrame:
    """Every different row once, with its copies, whether it is blank, truncated, or seen at an earlier turn."""
    end = F.rtrim(F.col("text"), F.lit(_SPACES))
    runs = (
        rows.groupBy("conv", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .withColumn("said", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
        .withColumn("end", F.substring(end, -1, 1))
        .withColumns({"blank": F.col("end") == "", "truncated": ~F.col("end").isin(".", "!", "?")})
        .drop("end")
    )
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        runs.filter("copies > 0")
        .groupBy("conv", "said")
        .agg(F.count("*").alias("n"), F.min(when).alias("when"))
        .filter("n > 1")
        .select(F.col("conv").alias("again_conv"), F.col("said").alias("again"), F.col("when").alias("earliest"))
    )
    found = F.col("conv").eqNullSafe(F.col("again_conv")) & (F.col("said") == F.col("again"))
    return runs.join(again, found, "left").select(
        "conv", "turn", "role", "text", "said", "copies", "blank", "truncated",
        F.coalesce(when > F.col("earliest"), F.lit(False)).alias("seen"),
    )


def _segments(faulty: DataFrame, kind: str, most: int) -> DataFrame:
    """Rows of neighbouring turns of one conversation, in order; a conversation without rows has an empty segment."""
    goes = F.col("blank") | F.col("seen")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 2).when(initial == "a", 4).otherwise(6)
    symbol = F.when(goes, GONE).otherwise(place + F.col("truncated").cast("int"))
    order = ["conv", "turn", "role", "said"]
    rows = (
        faulty.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", "role", F.when(~goes, F.col("text")).alias("text"), symbol.alias("symbol"), "blank", "copies")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_segment: _Segment | None = None
        done: list[tuple] = []
        for batch in batches:
            key = batch.schema.field(0).type
            if done:
                yield _segment_rows(done, key)
                done = []
            for conv, role, text, symbol, blank, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if open_segment and (conv != open_segment.conv or open_segment.full(most)):
                    done.append(open_segment.row(number))
                    number, open_segment = number + 1, None
                open_segment = open_segment or _Segment(conv)
                while copies > 0:
                    copies -= open_segment.add(role, text, symbol, blank, copies, most)
                    symbol = GONE
                    if copies:
                        done.append(open_segment.row(number))
                        number, open_segment = number + 1, _Segment(conv)
                        if len(done) >= BATCH_ROWS:
                            yield _segment_rows(done, key)
                            done = []
        if open_segment:
            yield _segment_rows([*done, open_segment.row(number)], key)

    return stored(small_batches(rows).mapInArrow(run, f"conv {kind}, {_SEGMENT_FIELDS}"), "segments")


class _Segment:
    """Neighbouring rows of a conversation, up to a number."""

    def __init__(self, conv: object) -> None:
        self.conv, self.symbols, self.turns, self.initials, self.size = conv, bytearray(), [], [], 0
        self.counts = dict.fromkeys(_COUNTS, 0)

    def full(self, most: int) -> bool:
        return len(self.symbols) >= most or self.size >= SEGMENT_BYTES

    def add(self, role: str, text: str | None, symbol: int, blank: bool, copies: int, most: int) -> int:
        """Take a row and as many of its copies as there is room for."""
        taken = min(copies, max(most - len(self.symbols), 1))
        stays = int(symbol != GONE)
        if stays:
            self.symbols.append(symbol)
            self.turns.append({"role": role, "text": text})
            self.size += len(text)
        self.symbols += bytes([GONE]) * (taken - stays)
        self.initials += [role[:1]] * taken
        self.counts["blank" if blank else "duplicate"] += taken - stays
        self.counts["truncated"] += stays and symbol % 2
        return taken

    def row(self, number: int) -> tuple:
        self.counts["illegal"] = sum(a + b not in _LEGAL for a, b in zip(self.initials, self.initials[1:], strict=False))
        ends = (self.initials[0], self.initials[-1]) if self.initials else (None, None)
        return self.conv, number, bytes(self.symbols), self.turns, *ends, *self.counts.values()


def _segment_rows(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.binary(), pa.list_(_turn_type), pa.string(), pa.string(), *[pa.int64()] * len(_COUNTS)]
    names = ["conv", "segment", "symbols", "turns", "first", "last", *_COUNTS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _chained(segments: DataFrame, kind: str) -> DataFrame:
    """For the segments of conversations that have several: the vector behind, the state before, illegal pairs at their edge."""
    counts = segments.groupBy(F.col("conv").alias("long")).count().filter("count > 1").select("long")
    many = segments.join(counts, F.col("conv").eqNullSafe(F.col("long")), "left_semi")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [blocks_of(s) for s in batch.column(2).to_pylist()]
            maps = [bytes(vectors_behind(b, v)[0] for v in range(len(tables().back))) for b in blocks]
            yield batch.append_column("map", pa.array(maps, pa.binary())).drop_columns(["symbols"])

    def last_to_first(group: pa.Table) -> pa.Table:
        group = group.sort_by([("segment", "descending")])
        behind = [0]
        for step in group["map"].to_pylist()[:-1]:
            behind.append(step[behind[-1]])
        return group.select(["segment"]).append_column("behind", pa.array(behind, pa.int32()))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for symbols, last in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                behind = vectors_behind(blocks_of(symbols), last)
                maps.append(bytes(functools.reduce(lambda _, made: made[3], choices(symbols, behind, s), s) for s in range(4)))
            yield batch.append_column("map", pa.array(maps, pa.binary())).drop_columns(["symbols"])

    def first_to_last(group: pa.Table) -> pa.Table:
        group = group.sort_by("segment")
        before, edges, previous = [START], [], None
        for step, first, last in zip(*[group[c].to_pylist() for c in ("map", "first", "last")], strict=True):
            before.append(step[before[-1]])
            edges.append(int(previous is not None and first is not None and previous + first not in _LEGAL))
            previous = previous if last is None else last
        final = [False] * (len(edges) - 1) + [True]
        return (
            group.select(["segment", "behind"])
            .append_column("before", pa.array(before[:-1], pa.int32()))
            .append_column("edge", pa.array(edges, pa.int64()))
            .append_column("final", pa.array(final, pa.bool_()))
        )

    narrow = many.select("conv", "segment", "symbols", "first", "last")
    maps = narrow.mapInArrow(functions, f"conv {kind}, segment bigint, first string, last string, map binary")
    behind = maps.groupBy("conv").applyInArrow(last_to_first, "segment bigint, behind int")
    maps = narrow.join(behind, "segment").select(*narrow.columns, "behind")
    maps = maps.mapInArrow(states, f"conv {kind}, segment bigint, first string, last string, behind int, map binary")
    schema = "segment bigint, behind int, before int, edge bigint, final boolean"
    return stored(maps.groupBy("conv").applyInArrow(first_to_last, schema), "chains")


def _line(turn: dict) -> bytes:
    return f"{turn['role']}:{turn['text']}".encode()


def _edited(segments: DataFrame, kind: str, with_turns: bool) -> DataFrame:
    """Every segment with its edits, and the digest of what is left if it is a whole conversation.

    The rows that are left come along if they are asked for or are needed for the digest of several segments.
    """
    chained = _chained(segments, kind).withColumnRenamed("segment", "own")
    rows = segments.join(chained, F.col("segment") == F.col("own"), "left")
    rows = rows.select("conv", "segment", *_COUNTS, "edge", "symbols", "turns", "behind", "before", "final")

    def edit(symbols: bytes, turns: list[dict], behind: int | None, before: int | None, final: bool | None) -> tuple:
        whole = behind is None
        state = START if whole else before
        audit, cost, left, own = [], 0, [], iter(turns)
        moves = choices(symbols, vectors_behind(blocks_of(symbols), 0 if whole else behind), state)
        for symbol, (letters, inserted, role, state, spent) in zip(symbols, moves, strict=True):
            audit.append(letters)
            cost += spent
            left += [{"role": r, "text": ""} for r in inserted]
            if symbol != GONE:
                turn = next(own)
                if role != "":
                    left.append({"role": role or turn["role"], "text": turn["text"]})
        if whole or final:
            letters, inserted, _ = tables().at_end[state]
            audit.append(letters)
            cost += INSERT * len(letters)
            left += [{"role": r, "text": ""} for r in inserted]
        digest = hashlib.sha256(b"\n".join(map(_line, left))).hexdigest() if whole else None
        return whole, "".join(audit), cost, digest, left if with_turns or not whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.list_(_turn_type)]
        names = ["conv", "segment", *_COUNTS, "whole", "audit", "cost", "sha256", "turns"]
        at = len(_COUNTS) + 2
        for batch in batches:
            if batch.num_rows:
                made = [edit(*row) for row in zip(*[c.to_pylist() for c in batch.columns[at + 1 :]], strict=True)]
                illegal = pa.compute.add(batch.column(at - 1), pa.compute.fill_null(batch.column(at), 0))
                new = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: at - 1], illegal, *new], names=names)

    return rows.mapInArrow(run, f"conv {kind}, {_EDITED_FIELDS}")


def _digests(pieces: DataFrame, kind: str) -> DataFrame:
    """The digest of conversations of several segments: one task streams each, in constant memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, lines, there, key = None, hashlib.sha256(), 0, False, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], key), pa.array([digest.hexdigest()])], names=["long", "sha256"])

        for batch in batches:
            key = batch.schema.field(0).type
            for own, turns in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if there and own != conv:
                    yield closed()
                    digest, lines = hashlib.sha256(), 0
                conv, there = own, True
                for turn in turns:
                    digest.update(b"\n" * (lines > 0) + _line(turn))
                    lines += 1
        if there:
            yield closed()

    ordered = pieces.select("conv", "segment", "turns").repartition("conv").sortWithinPartitions("conv", "segment")
    return ordered.mapInArrow(run, f"long {kind}, sha256 string")


def _prepared(turns: DataFrame) -> tuple[DataFrame, str]:
    kind = turns.schema["conv"].dataType.simpleString()
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    return turns.select("conv", F.col("turn").cast("long").alias("turn"), *spaced, copies.alias("copies")), kind


def repaired(turns: DataFrame, most: int = SEGMENT) -> DataFrame:
    """The rows (conv, place, role, text) that are left of rows (conv, turn, role, text[, copies]); places are in order, with gaps."""
    rows, kind = _prepared(turns)
    edited = _edited(_segments(_faulty(rows), kind, most), kind, with_turns=True)
    exploded = edited.select("conv", "segment", F.posexplode("turns").alias("at", "turn"))
    place = F.col("segment") * (1 << 14) + F.col("at")
    return exploded.select("conv", place.alias("place"), "turn.role", "turn.text")


def summaries(turns: DataFrame, most: int = SEGMENT) -> DataFrame:
    """For each conversation of rows (conv, turn, role, text[, copies]): faults, gaps, cost, audit and digest of the repair."""
    rows, kind = _prepared(turns)
    edited = stored(_edited(_segments(_faulty(rows), kind, most), kind, with_turns=False), "edited")
    columns = ["conv", *_COUNTS, "cost", "audit", "sha256"]
    pieces = edited.filter("NOT whole")
    joined = pieces.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in [*_COUNTS, "cost"]],
        F.array_join(F.array_sort(F.collect_list(F.struct("segment", "audit")))["audit"], "").alias("audit"),
    )
    joined = joined.join(_digests(pieces, kind), F.col("conv").eqNullSafe(F.col("long"))).select(columns)
    there = rows.filter("copies > 0 AND turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1))
    gaps = there.groupBy(F.col("conv").alias("own")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    return (
        edited.filter("whole").select(columns).union(joined)
        .join(gaps, F.col("conv").eqNullSafe(F.col("own")), "left")
        .select("conv", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), *columns[1:])
    )
