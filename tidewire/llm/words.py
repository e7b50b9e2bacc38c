"""Whole texts as arrays of word hashes, and the loop over documents that uses them.

Words are found and hashed with array operations on the UTF-8 bytes: a running sum of
byte * base^position modulo 2^64 gives the value of any stretch of bytes as a difference.
Texts are worked through in segments of a megabyte; a word that a segment's edge cuts is carried over it. So besides the
text itself and eight bytes for each word, memory does not depend on a text's length, with blanks or without.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 1 << 20
BATCH_ROWS = 500
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64

SPACES = b"\t\n\x0b\x0c\r "


def _lookup(is_word: Callable[[int], bool], lower: bool) -> np.ndarray:
    values = np.zeros(256, U64)
    for byte in range(256):
        if is_word(byte):
            values[byte] = byte + 33 if lower and 65 <= byte <= 90 else byte + 1
    return values


#: Words between white space, as they are; the same with A-Z in lower case.
BLANK = _lookup(lambda b: b not in SPACES, lower=False)
BLANK_LOWER = _lookup(lambda b: b not in SPACES, lower=True)
#: Words of letters and digits (all of those beyond ASCII), A-Z in lower case.
ALNUM = _lookup(lambda b: b >= 128 or chr(b).isalnum(), lower=True)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_tables = [_powers(BASE, SEGMENT + 1), _powers(pow(BASE, -1, 1 << 64), SEGMENT + 1)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all of its bits (one to one)."""
    h = h ^ (h >> U64(32))
    h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


#: What the first two bytes of a character beyond U+07FF say: a word of its own, a gap, or full-width forms of both.
_OWN, _GAP, _WIDE = 1, 2, 3
#: Scripts written without blanks, by first and last code point (whole blocks of 64).
_OWN_BLOCKS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FFF), (0x3040, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF),
    (0xFF40, 0xFFBF), (0x20000, 0x33FFF),
)
_GAP_BLOCKS = ((0x2000, 0x207F), (0x3000, 0x303F))
_WIDE_BLOCK = (0xFF00, 0xFF3F)


def _kinds() -> np.ndarray:
    kinds = np.zeros(1 << 16, np.uint8)
    for kind, blocks in ((_OWN, _OWN_BLOCKS), (_GAP, _GAP_BLOCKS), (_WIDE, (_WIDE_BLOCK,))):
        for first, last in blocks:
            step = 64 if last < 1 << 16 else 1 << 12
            for code in range(first, last + 1, step):
                kinds[int.from_bytes(chr(code).encode()[:2], "big")] = kind
    return kinds


_KINDS = _kinds()


def _characters(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where words have to be cut around characters that are words of their own; punctuation becomes a gap."""
    lead = np.flatnonzero(data >= 0xE0)
    kinds = _KINDS[data[lead].astype(np.int64) << 8 | data[lead + 1]]
    third = data[lead[kinds == _WIDE] + 2]
    digit_or_letter = ((third >= 0x90) & (third <= 0x99)) | ((third >= 0xA1) & (third <= 0xBA))
    kinds[kinds == _WIDE] = np.where(digit_or_letter, _OWN, _GAP)
    for at in (0, 1, 2):
        values[lead[kinds == _GAP] + at] = 0
    own = lead[kinds == _OWN]
    return np.concatenate([own, own + np.where(data[own] >= 0xF0, 4, 3)])


def _segment(data: np.ndarray, lookup: np.ndarray, by_character: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and values of the words of one stretch of bytes, and where words have to be cut."""
    values = lookup[data]
    cuts = _characters(data, values) if by_character else np.zeros(0, np.int64)
    word = np.zeros(len(data) + 2, bool)
    np.not_equal(values, 0, out=word[1:-1])
    begins, stops = word[1:] & ~word[:-1], word[:-1] & ~word[1:]
    if len(cuts):
        begins[cuts] |= word[1:][cuts]
        stops[cuts] |= word[:-1][cuts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(values * _tables[0][: len(data)], out=sums[1:])
    return starts, ends, (sums[ends] - sums[starts]) * _tables[1][starts], cuts


def hashes(texts: Sequence[bytes | None], lookup: np.ndarray, by_character: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's words begin (one entry more than texts).

    With ``by_character`` every character of a script without blanks is a word, and the
    punctuation of such scripts and of books is a gap.
    """
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    lengths = np.array([len(t or b"") for t in texts], np.int64)
    text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    unfinished: tuple[int, int, int] | None = None  # start, value and length of a word that a segment's edge cuts
    at = 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        for _ in range(3):  # not inside a character
            end -= bool(end < len(data) and data[end] & 0xC0 == 0x80)
        starts, ends, values, cuts = _segment(data[at:end], lookup, by_character)
        starts, ends = starts + at, ends + at
        if unfinished:
            start, value, length = unfinished
            if len(starts) and starts[0] == at and not (len(cuts) and (cuts == 0).any()):
                ahead = pow(BASE, length, 1 << 64) * int(values[0]) & (1 << 64) - 1
                values[0] = U64((value + ahead) & (1 << 64) - 1)
                starts[0] = start
            else:
                starts, ends = np.concatenate([[start], starts]), np.concatenate([[at], ends])
                values = np.concatenate([np.array([value], U64), values])
            unfinished = None
        if len(ends) and ends[-1] == end and end < len(data) and not (len(cuts) and (cuts == end - at).any()):
            unfinished = int(starts[-1]), int(values[-1]), end - int(starts[-1])
            starts, values = starts[:-1], values[:-1]
        found.append((starts, mixed(values)))
        at = end
    starts = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.int64)
    h = np.concatenate([h for _, h in found]) if found else np.zeros(0, U64)
    return h, np.searchsorted(starts, text_starts)


def runs(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``k`` words inside a text: their hashes, first words, and texts."""
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(text)) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    total = np.zeros(len(first), U64)
    for i in range(k):
        total = total * U64(BASE) + h[first + i]
    return mixed(total), first, text


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one a word) by text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def parts(lengths: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``most`` bytes in all, one text at least."""
    sums = np.cumsum(lengths + 1)
    at = 0
    while at < len(lengths):
        base = sums[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sums, base + most, side="right")))
        yield at, end
        at = end


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, in a session that hands BATCH_ROWS rows at a time to Python.

    Whole documents are long; a batch of the usual 10,000 would take hundreds of
    megabytes on both sides of each running task.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def per_document(
    docs: DataFrame,
    keep: Sequence[str],
    function: Callable[[list[bytes | None]], Sequence[pa.Array]],
    fields: Sequence[T.StructField],
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with what ``function`` returns for the whole texts.

    ``function`` gets the UTF-8 bytes of some texts, in order, and returns an array for
    each of ``fields``. No rows move; memory is bounded by the longest text or a
    segment. A kept column that has the name of a new one is left out.
    """
    names = {f.name for f in fields}
    kept = [c for c in keep if c not in names]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text).cast("string").cast("binary").alias("text bytes"))
    schema = T.StructType([docs.schema[c] for c in kept] + list(fields))
    columns = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in parts(lengths):
                made = function(texts.slice(start, end - start).to_pylist())
                old = [c.slice(start, end - start) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*old, *made], names=columns)

    return small_batches(rows).mapInArrow(run, schema)
