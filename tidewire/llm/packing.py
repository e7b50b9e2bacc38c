"""Lexical retrieval packing: windows of a seed document and its unused neighbours by BM25.

Every document is its token ids and an end id. A document of a window or more gives whole windows by itself; what is left
of it, or a shorter document, is a unit. Term and document counts for BM25 are taken over all units (terms are token
ids, so the table has a proven bound: the vocabulary). Units are ordered by their weightiest terms (often in the unit, late in the
tokenizer's vocabulary, which ranks by frequency), which brings copies and texts on one subject together, and this order is cut into shards of about SHARD_TOKENS tokens, each with its own
inverted index. Within a shard the first unused unit is a seed; the index returns the unused units by falling score, and
they fill the seed's window. The one that does not fit is cut, and its rest is the next seed. What a
shard has left over goes to the next one of its task.

So windows are full. The last units of a task, less than a window, are laid out in sequences whose lengths are
powers of two, which need no padding either.

Within its shard the retrieval is exact: every posting of every term of a seed is counted. A shard is bounded by its tokens, however
many units share a term or a text; equal units are spread over shards by their order.

Defined results: a null or empty text is its end id alone. Repeated rows are packed like others. Ties in score go by the
units' order, which their contents and ``keep`` decide. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.token_ids import word_ids
from tidewire.llm.words import small_batches
from tidewire.operators.lineage import stored

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1 << 21
K1, B = 1.2, 0.75
DENSE = 16

FIELDS = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
_ID_TYPE = pa.list_(pa.int32())


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Postings:
    """An inverted index of some units under BM25 with given term weights.

    The lists of terms in one unit of DENSE or more are rows of a matrix, which is at most DENSE times as large as
    the lists.
    """

    def __init__(self, units: Sequence[np.ndarray], idf: np.ndarray, average: float) -> None:
        self.count = len(units)
        lengths = np.array([len(u) for u in units])
        ids, unit = np.concatenate(units), np.repeat(np.arange(self.count, dtype=np.int32), lengths)
        by_term = np.argsort(ids, kind="stable")  # units stay in order
        term, unit = ids[by_term], unit[by_term]
        starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (unit[1:] != unit[:-1])))
        times = np.diff(starts, append=len(ids))
        term, unit = term[starts], unit[starts]
        weight = weights(times, idf[term], lengths[unit], average)
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        frequent = np.flatnonzero(np.diff(self.first) * DENSE >= self.count)
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.count))
        for row, t in enumerate(frequent):
            span = slice(self.first[t], self.first[t + 1])
            self.dense[row, unit[span]] = weight[span]
        by_unit = np.argsort(unit, kind="stable")
        self.terms = np.split(term[by_unit], np.searchsorted(unit[by_unit], np.arange(1, self.count)))
        self.unit, self.weight = unit.astype(np.intp), weight

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every unit for the different terms of one."""
        rows = self.row[self.terms[seed]]
        total = self.dense[rows[rows >= 0]].sum(axis=0)
        rare = self.terms[seed][rows < 0]
        if len(rare):
            spans = list(map(slice, self.first[rare].tolist(), self.first[rare + 1].tolist()))
            units, parts = [self.unit[s] for s in spans], [self.weight[s] for s in spans]
            total += np.bincount(np.concatenate(units), np.concatenate(parts), minlength=self.count)
        return total


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids and how often each occurs (at least one id is there)."""
    ranked = np.sort(ids, kind="stable")
    last = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]), len(ranked) - 1)
    return ranked[last], np.diff(last, prepend=-1)


def weights(times: np.ndarray, idf: np.ndarray, lengths: np.ndarray | int, average: float) -> np.ndarray:
    return idf * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / average))


def windows(postings: Postings, lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Full windows as (unit, from, to); then one list, not filled, of what is left."""
    used = np.zeros(len(lengths), bool)
    left, rest = int(lengths.sum()), None
    while left >= window:
        if rest is None:
            rest = (int(np.argmin(used)), 0)
        seed, begin = rest
        used[seed], rest = True, None
        filled = [(seed, begin, int(lengths[seed]))]
        room = window - int(lengths[seed]) + begin
        near = np.argsort(np.where(used, np.inf, -postings.scores(seed)), kind="stable")
        reach = np.cumsum(lengths[near])
        whole = int(np.searchsorted(reach, room, side="right")) if room else 0
        filled += [(int(u), 0, int(lengths[u])) for u in near[:whole]]
        used[near[:whole]] = True
        room -= int(reach[whole - 1]) if whole else 0
        if room:
            cut = int(near[whole])
            filled.append((cut, 0, room))
            used[cut], rest = True, (cut, room)
        left -= window
        yield filled
    begun = [(rest[0], rest[1], int(lengths[rest[0]]))] if rest else []
    yield begun + [(int(u), 0, int(lengths[u])) for u in np.flatnonzero(~used)]


def powers_of_two(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces cut into lists whose lengths are different powers of two, the longest first."""
    total, queue = sum(b - a for _, a, b in pieces), list(reversed(pieces))
    for power in reversed(range(total.bit_length())):
        room, own = total & (1 << power), []
        while room:
            unit, a, b = queue.pop()
            taken = min(b - a, room)
            own.append((unit, a, a + taken))
            if a + taken < b:
                queue.append((unit, a + taken, b))
            room -= taken
        if own:
            yield own


def _tokenized(docs: DataFrame, kept: Sequence[str], text: str, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """Whole windows of long documents, each a sequence, and units with their ids and key; stored.

    Every task adds a row of its own (``unit`` is null): in how many units each id occurs, units, and ids.
    """
    rows = docs.select(*[F.col(c) for c in kept], F.col(text).cast("string").cast("binary").alias("text of the document"))
    own = [T.StructField(c, docs.schema[c].dataType) for c in kept]
    new = [T.StructField("unit", T.BooleanType()), *FIELDS, *[T.StructField(c, T.BinaryType()) for c in ("packed", "key")]]
    schema = T.StructType(own + new)
    kinds = [pa.bool_(), *[pa.int64()] * len(FIELDS), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = word_ids(path), TaskContext.get().partitionId() << 32
        rarity = np.log(np.arange(2, table.size + 2))
        rarity[end_id] = 0
        counts = np.zeros(table.size + 2, np.int64)
        batch = None

        def made(at: list[int], out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int32())) for c in batch.columns[:-1]], *columns], names=schema.names)

        for batch in batches:
            at, out = [], []
            texts = [text or b"" for text in batch.column(batch.num_columns - 1).to_pylist()]
            for row, found in enumerate(table.of(texts)):
                ids = np.append(found, np.array([end_id], table.type))
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    data = part.tobytes()
                    at.append(row)
                    if len(part) < window:
                        terms, times = terms_of(part)
                        counts[terms] += 1
                        counts[-2:] += (1, len(part))
                        top = terms[np.argsort(-rarity[terms] * times / (times + K1), kind="stable")[:3]]
                        key = top.astype(">u4").tobytes() + zlib.crc32(data).to_bytes(4, "big")
                        out.append((True, start, len(part), None, len(ids), None, None, data, key))
                    else:
                        out.append((False, start, window, crc(part), len(ids), 2 * number + 1, 0, data if with_ids else None, None))
                        number += 1
                if len(out) >= 2000:
                    yield made(at, out)
                    at, out = [], []
            if out:
                yield made(at, out)
        if batch is not None and counts[-1]:
            yield made([None], [(None, *[None] * len(FIELDS), counts.astype("<i8").tobytes(), None)])

    return stored(small_batches(rows).mapInArrow(run, schema), "tokens")


def _statistics(tokenized: DataFrame, size: int) -> tuple[np.ndarray, float, int]:
    """Weight of every term, mean length and ids in all, over all units: as many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 2, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts += np.frombuffer(data, "<i8")
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["term", "n"])

    counts = np.zeros(size + 2)
    parts = tokenized.filter("unit IS NULL").select("packed").mapInArrow(run, "term int, n long")
    for row in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row.term] = row.n
    n, tokens = counts[-2:]
    return np.log1p((n - counts[:-2] + 0.5) / (counts[:-2] + 0.5)), tokens / max(n, 1), int(tokens)


def pack(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents: the columns ``keep``, where a piece is in its document and in its sequence.

    With ``with_ids`` the pieces' ids come along. A kept column that has the name of a new one is left out.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    fields = FIELDS + [IDS] * with_ids
    names = {f.name for f in fields} | {"unit", "packed", "key"}
    kept = [c for c in keep if c not in names]
    tokenized = _tokenized(docs, kept, text, path, window, end_id, with_ids)
    units = tokenized.filter("unit")
    size, kind = word_ids(path).size, word_ids(path).type
    idf, average, tokens = _statistics(tokenized, size)
    idf[end_id] = 0.0
    schema = T.StructType([docs.schema[c] for c in kept] + fields)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # kept values, start, document's tokens, ids
        size = 0

        def rows(sequences: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal number
            out = []
            for pieces in sequences:
                offset = 0
                for unit, a, b in pieces:
                    values, start, doc_tokens, ids = held[unit]
                    row = (*values, start + a, b - a, crc(ids[a:b]), doc_tokens, 2 * number, offset)
                    out.append((*row, ids[a:b]) if with_ids else row)
                    offset += b - a
                number += 1
            kinds = [*kept_kinds, *[pa.int64()] * len(FIELDS), *[_ID_TYPE] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

        def emptied(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            ids = [u[3] for u in held]
            *full, over = windows(Postings(ids, idf, average), np.array([len(i) for i in ids]), window)
            full += powers_of_two(over) if last else []
            for at in range(0, len(full), 256):
                yield rows(full[at : at + 256])
            held = [] if last else [(held[u][0], held[u][1] + a, held[u][2], held[u][3][a:b]) for u, a, b in over]
            size = sum(len(u[3]) for u in held)

        kept_kinds: list[pa.DataType] = []
        for batch in batches:
            kept_kinds = [c.type for c in batch.columns[: len(kept)]]
            values = zip(*[c.to_pylist() for c in batch.columns[: len(kept)]], strict=True) if kept else [()] * batch.num_rows
            rest = [c.to_pylist() for c in batch.columns[len(kept) :]]
            for own, start, doc_tokens, data in zip(values, *rest, strict=True):
                held.append((own, start, doc_tokens, np.frombuffer(data, kind)))
                size += len(held[-1][3])
                if size >= shard_tokens:
                    yield from emptied(last=False)
        if held:
            yield from emptied(last=True)

    columns = [*kept, "start", "doc_tokens", "packed"]
    order = ["key", "start", "doc_tokens", *[c for c in kept if not isinstance(docs.schema[c].dataType, T.MapType)]]
    placed = (
        units.select(*columns, "key")
        .repartitionByRange(tokens // shard_tokens + 1, *order)
        .sortWithinPartitions(*order)
        .select(*columns)
        .mapInArrow(filled, schema)
    )
    long = tokenized.filter("NOT unit")
    if with_ids:

        @F.pandas_udf(IDS.dataType)
        def unpacked(data):  # noqa: ANN001, ANN202
            return data.map(lambda b: np.frombuffer(b, kind).astype(np.int32))

        long = long.withColumn("ids", unpacked("packed"))
    return long.select(schema.names).union(placed)
