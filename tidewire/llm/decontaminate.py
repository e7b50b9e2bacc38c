"""Benchmark decontamination by greedy string tiling.

Seeds are the Karp-Rabin hashes of LEAST_TILE consecutive words; in scripts without blanks every character
is a word. A bitmap of fixed size over the
benchmark's seeds tells, while texts are read, nearly all words of documents apart from
it; what passes is joined with the benchmark's seeds by hash. Every match of LEAST_TILE
or more words between a document and an item is a run of seeds on one diagonal, so greedy string
tiling needs the seeds alone: the longest unmarked match becomes a tile, its words are marked on
both sides, matches that overlap it are cut, and so on. Tiles may lie in any order, so a
reordered passage is found like an unchanged one. The part of an item's words that
lies in tiles is its coverage.

The bitmap costs BITMAP_BITS / 8 bytes whatever the benchmark's size; a larger benchmark only
lets more seeds through to the join, which Spark shuffles. The benchmark's side of that join is copied
SALTS times, so a passage that many documents share is met by SALTS groups.

Defined results: null and empty texts, and items of fewer than LEAST_TILE words, match
nothing; equal rows get equal results; a document is known by its id and text, so rows
of equal id (or none) and different text stay apart.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import words
from tidewire.llm.bitmaps import Bitmap, bitmap
from tidewire.llm.tables import checked_broadcast

LEAST_TILE = 5
LEAST_COVERED = 0.6
BITMAP_BITS = 24
SALTS = 16

_SEED = [
    T.StructField("seed", T.LongType()),
    T.StructField("at", T.IntegerType()),
    T.StructField("n_words", T.IntegerType()),
]


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _seeds(rows: DataFrame, keep: list[str], known: Bitmap | None = None) -> DataFrame:
    """``keep`` and each seed of ``text``, with its first word and the text's words."""
    schema = T.StructType([*(rows.schema[c] for c in keep), *_SEED])
    rows = rows.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lengths = np.array([len(t or b"") for t in texts.to_pylist()], np.int64)
            for start, end in words.parts(lengths):
                h, bounds = words.hashes(texts.slice(start, end - start).to_pylist(), words.ALNUM, by_character=True)
                seed, first, text = words.runs(h, bounds, LEAST_TILE)
                if known is not None:
                    passed = np.flatnonzero(known.has(seed))
                    seed, first, text = seed[passed], first[passed], text[passed]
                made = [seed.view(np.int64), (first - bounds[text]).astype(np.int32), np.diff(bounds)[text].astype(np.int32)]
                kept = [c.take(pa.array(text + start)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, made)], names=schema.names)

    return words.small_batches(rows).mapInArrow(run, schema)


def tiles(matches: list[tuple[int, int]], k: int = LEAST_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of seeds (place in the text, place in the item) as (text, item, words).

    Longest first; of equal ones the first in the text, then in the item.
    """
    queue: list[tuple[int, int, int]] = []
    at = None
    for text, item in sorted(set(matches), key=lambda m: (m[0] - m[1], m[0])):
        if at and text - item == at[0] - at[1] and text == at[0] + at[2]:
            at[2] += 1
        else:
            if at:
                queue.append((-(at[2] + k - 1), at[0], at[1]))
            at = [text, item, 1]
    if at:
        queue.append((-(at[2] + k - 1), at[0], at[1]))
    heapq.heapify(queue)
    text_marks: set[int] = set()
    item_marks: set[int] = set()
    out = []
    while queue:
        n, text, item = heapq.heappop(queue)
        free = [text + i not in text_marks and item + i not in item_marks for i in range(-n)]
        if all(free):
            out.append((text, item, -n))
            text_marks.update(range(text, text - n))
            item_marks.update(range(item, item - n))
            continue
        start = 0
        for i in range(-n + 1):
            if i == -n or not free[i]:
                if i - start >= k:
                    heapq.heappush(queue, (-(i - start), text + start, item + start))
                start = i + 1
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, least_covered: float = LEAST_COVERED, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Pairs (key, text_id, item, covered, tiles, longest_tile, item_words) with enough coverage."""
    items = benchmark.select(F.col(item).alias("item"), "text")
    item_seeds = _seeds(items, ["item"]).withColumnsRenamed({"at": "item_at", "n_words": "item_words"})
    known = bitmap(item_seeds.select("seed"), BITMAP_BITS)
    rows = docs.select(F.col(key).alias("key"), fingerprint(F.col("text")).alias("text_id"), "text")
    salt = F.pmod(F.xxhash64("text_id", "at"), F.lit(SALTS)).cast("int")
    found = _seeds(rows, ["key", "text_id"], known).drop("n_words").withColumn("salt", salt)
    salted = item_seeds.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    pairs = (
        found.join(salted, ["seed", "salt"])
        .groupBy("key", "text_id", "item", "item_words")
        .agg(F.collect_set(F.struct("at", "item_at")).alias("matches"))
        # Each seed covers LEAST_TILE words at most: without enough of them no tiling can.
        .filter(F.size("matches") * F.lit(LEAST_TILE) >= F.col("item_words") * F.lit(least_covered))
    )
    schema = T.StructType([
        *(pairs.schema[c] for c in ("key", "text_id", "item", "item_words")),
        T.StructField("covered", T.DoubleType()),
        T.StructField("tiles", T.IntegerType()),
        T.StructField("longest_tile", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, matches in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = [t[2] for t in tiles([(m["at"], m["item_at"]) for m in matches])]
                made.append((sum(found) / n, len(found), max(found)))
            covered, count, longest = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(covered, pa.float64()), pa.array(count, pa.int32()), pa.array(longest, pa.int32())],
                names=schema.names,
            )

    return (
        pairs.mapInArrow(run, schema)
        .filter(F.col("covered") >= least_covered)
        .withColumnsRenamed({"key": key, "item": item})
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without those that cover an item of the benchmark."""
    bad = checked_broadcast(
        overlaps(docs, benchmark, key=key).select(F.col(key).alias("_key"), F.col("text_id").alias("_text")).distinct(),
        "leaks",
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (fingerprint(F.col("text")) == F.col("_text"))
    return docs.join(bad, same, "left_anti")
