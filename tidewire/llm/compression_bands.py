"""Quality rules: zstandard ratios of whole documents and of fixed chunks, in bands by length.

Text that repeats itself compresses far better than prose, encoded or random text hardly at
all; how far depends on the length. A document is rejected when its compressed share lies
outside the band of its length, or more than half of its chunks lie outside theirs. From CHUNK bytes on there
are chunks; what is left after the last full one is judged as the last CHUNK bytes.
The counts of the base rules come along: code points in words, symbols, repeated lines, and
words in runs of eight that occur twice or more in the text.

Defined results: a null or empty text has no words and fails the base rules; the shortest
texts have a band that no text leaves; equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm import words

LEVEL = 3
CHUNK = 4096
#: From so many bytes: least compressed share.
LEAST = ((0, 0.0), (100, 0.30), (500, 0.25), (3000, 0.20), (50_000, 0.15))
#: At so many bytes: most compressed share, on lines over the logarithm of the length. The limits lie between prose
#: and noise in valid text (base64, random letters and digits, random ASCII or CJK); shorter texts have none.
MOST = ((100, 1.03), (150, 0.97), (200, 0.92), (300, 0.86), (500, 0.79), (1000, 0.73), (3000, 0.68))
CHUNK_BAND = (0.15, 0.68)
MOST_BAD_CHUNKS = 0.5

RUN = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
_NOT_CODE_POINTS = words.SPACES + bytes(range(0x80, 0xC0))

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("bad_chunks", T.DoubleType()),
]


def repeated_words(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its words, and those in runs of RUN words found twice or more in it."""
    h, bounds = words.hashes(texts, words.BLANK)
    value, first, text = words.runs(h, bounds, RUN)
    keyed = words.mixed(value ^ words.mixed(text.astype(np.uint64)))
    order = np.argsort(keyed)
    ranked = keyed[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = first[order[twice]]
    edges = np.bincount(at, minlength=len(h) + RUN + 1) - np.bincount(at + RUN, minlength=len(h) + RUN + 1)
    covered = np.cumsum(edges)[: len(h)] > 0
    return np.diff(bounds), words.per_text(covered, bounds)


def band(length: int) -> tuple[float, float]:
    low = next(low for start, low in reversed(LEAST) if length >= start)
    if length < MOST[0][0]:
        return low, 9.0
    lengths, highs = zip(*MOST, strict=True)
    return low, float(np.interp(np.log(length), np.log(lengths), highs))


def shares(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Compressed share of the text, and the part of its chunks out of their band."""
    if not text:
        return 0.0, 0.0
    whole = len(packer.compress(text)) / len(text)
    starts = list(range(0, len(text) - CHUNK + 1, CHUNK))
    if not starts:
        return whole, 0.0
    if len(text) % CHUNK:
        starts.append(len(text) - CHUNK)
    sizes = [len(packer.compress(text[i : i + CHUNK])) / CHUNK for i in starts]
    return whole, sum(not CHUNK_BAND[0] <= s <= CHUNK_BAND[1] for s in sizes) / len(starts)


def judge(texts: list[bytes | None]) -> list[pa.Array]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    n_words, repeated = repeated_words(texts)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words)
    rows = []
    for text, base_failed in zip(texts, failed, strict=True):
        text = text or b""
        lines = [line for line in text.split(b"\n") if line.strip(words.SPACES)]
        ratio, bad = shares(text, packer)
        low, high = band(len(text))
        rows.append((
            len(text.translate(None, _NOT_CODE_POINTS)),
            len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)),
            not base_failed and low <= ratio <= high and bad <= MOST_BAD_CHUNKS,
            ratio,
            bad,
        ))
    chars, symbols, lines, kept, ratios, bad = zip(*rows, strict=True)
    return [
        pa.array(n_words, pa.int64()), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()),
        pa.array(lines, pa.int64()), pa.array(repeated, pa.int64()), pa.array(failed, pa.bool_()),
        pa.array(kept, pa.bool_()), pa.array(ratios, pa.float64()), pa.array(bad, pa.float64()),
    ]


def compression_bands(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` of each document with its counts, shares and verdict."""
    return words.per_document(docs, keep, judge, FIELDS, text)
