"""Language identification with a blended spectrum kernel, Nystroem landmarks and ridge regression.

Texts are cut into pieces of PIECE bytes. A piece is the set of its n-grams of UTF-8 bytes, n in
GRAMS, each hashed into one of SLOTS places of its n; the kernel of two pieces is the number of
places both have, over the geometric mean of their own numbers. LANDMARKS training pieces make
the Nystroem map: a piece becomes its kernel values with the landmarks times the inverse root of
the landmarks' own kernel matrix. On these features one ridge regression per language
tells it from the rest. All of a text's pieces are scored, as products of matrices of many
pieces, and their scores are averaged by length.

The model is fitted on the driver to about SAMPLE documents of each of the MOST_LANGUAGES languages with
most documents (an equal share of MOST_SAMPLE, where that is less; of at most LONGEST_SAMPLE characters), drawn by a hash of
their ids; rarer languages give all they have. Scores cover whole texts of all documents.

Defined results: null texts and texts without a letter are ``und`` with score 0; null languages and
ids are not learned from; equal texts get equal predictions; without anything to
learn from, every document is ``und``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import words

PIECE = 2048
GRAMS = (1, 2, 3, 4)
SLOTS = 2048
LANDMARKS = 160
RIDGE = 1e-2
SAMPLE = 600
MOST_LANGUAGES = 1000
MOST_SAMPLE = 20_000
LONGEST_SAMPLE = 20_000
#: Training pieces of one document, taken evenly over its text.
MOST_PIECES = 4
BATCH = 512
UNKNOWN = "und"

_LOWER = np.array([b + 32 if 65 <= b <= 90 else (32 if b in words.SPACES else b) for b in range(256)], np.uint32)


def pieces(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all texts, and the text of each. A short rest goes with the piece before it."""
    out, owner = [], []
    for number, text in enumerate(texts):
        count = max(1, round(len(text) / PIECE))
        edges = [len(text) * i // count for i in range(count + 1)]
        out += [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        owner += [number] * count
    return out, np.array(owner, np.int64)


def presence(some: Sequence[bytes]) -> np.ndarray:
    """A row of 0 and 1 for each piece: which n-grams it has, scaled to length 1."""
    out = np.zeros((len(some), len(GRAMS) * SLOTS), np.float32)
    for row, piece in zip(out, some, strict=True):
        data = _LOWER[np.frombuffer(piece, np.uint8)]
        value = np.zeros(len(data), np.uint32)
        for i, n in enumerate(GRAMS):
            if len(data) < n:
                break
            value = value[: len(data) - n + 1] * np.uint32(257) + data[n - 1 :] + np.uint32(1)
            row[i * SLOTS + ((value * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)] = 1.0
    size = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.maximum(size, 1.0)


@dataclass
class Model:
    """Landmarks' n-grams, and the weights from kernel values to languages (last row: constant)."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row of scores for each text, one for each language."""
        some, owner = pieces(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(some), BATCH):
            kernel = presence(some[at : at + BATCH]) @ self.landmarks.T
            lengths = np.array([[len(p)] for p in some[at : at + BATCH]], np.float64)
            np.add.at(out, owner[at : at + BATCH], (kernel @ self.weights[:-1] + self.weights[-1]) * lengths)
        return out / np.maximum(np.array([[len(t)] for t in texts], np.float64), 1.0)


def fit(texts: Sequence[bytes], languages: Sequence[str]) -> Model:
    """The model of some labelled texts."""
    names = tuple(sorted(set(languages)))
    some, owner = pieces(texts)
    count = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(count)[:-1]])[owner]
    taken = np.flatnonzero(nth % np.ceil(count / MOST_PIECES).astype(np.int64)[owner] == 0)
    kind = np.array([names.index(languages[i]) for i in owner[taken]])
    rows = presence([some[i] for i in taken])
    # Landmarks: the languages in turn, each from its first pieces on.
    turn = np.zeros(len(kind), np.int64)
    for k in range(len(names)):
        turn[kind == k] = np.arange((kind == k).sum())
    chosen = np.lexsort((kind, turn))[: max(LANDMARKS, len(names))]
    landmarks = rows[chosen]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    big = values > 1e-6 * values.max()
    root = vectors[:, big] / np.sqrt(values[big])
    features = np.hstack([(rows @ landmarks.T).astype(np.float64) @ root, np.ones((len(rows), 1))])
    # Each language weighs the same, however many pieces it has.
    weight = (1.0 / np.bincount(kind, minlength=len(names)))[kind][:, None] / len(names)
    goal = np.where(kind[:, None] == np.arange(len(names)), 1.0, -1.0)
    pull = RIDGE / max(1, len(names)) * np.eye(features.shape[1]) / max(1, len(kind)) ** 0.5
    solved = np.linalg.solve(features.T @ (features * weight) + pull, features.T @ (goal * weight))
    weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return Model(names, landmarks, weights.astype(np.float32))


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from; null ids are never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(4) == F.lit(2), F.lit(False))


def shortened(text: Column) -> Column:
    """A text to learn from: of a long one, MOST_PIECES pieces taken evenly over it."""
    size = F.length(text)
    part = [F.substr(text, F.floor(size * F.lit(i) / F.lit(MOST_PIECES)).cast("int") + F.lit(1), F.lit(PIECE)) for i in range(MOST_PIECES)]
    return F.when(size <= LONGEST_SAMPLE, text).otherwise(F.concat(*part))


def sample(docs: DataFrame) -> DataFrame:
    """Rows (text, lang) to learn from: about SAMPLE of each language or its share of MOST_SAMPLE, or all it has."""
    known = docs.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = known.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("n"))
    taken = counts.orderBy(F.desc("n"), "_lang").limit(MOST_LANGUAGES)
    languages = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))  # of MOST_LANGUAGES rows at most
    taken = taken.withColumn("rows", F.least(F.lit(float(SAMPLE)), F.lit(float(MOST_SAMPLE)) / languages))
    chance = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (
        known.filter(F.col("text").rlike(r"\p{L}"))
        .select("doc_id", shortened(F.col("text")).alias("text"), F.col("lang").cast("string").alias("lang"), chance.alias("chance"))
        .join(F.broadcast(taken), F.col("lang") == F.col("_lang"))
        # A language's rows come at the numbers 0 to n, so what the draws give beyond the bound is cut from the largest ones.
        .withColumn("nth", F.col("chance") * F.col("n"))
        .filter(F.col("nth") < F.col("rows"))
        .orderBy("nth", "doc_id", "text")
        .select("text", "lang")
        .limit(MOST_SAMPLE)
    )


def learn(docs: DataFrame) -> Model | None:
    rows = sample(docs).toPandas()
    return fit([t.encode() for t in rows["text"]], rows["lang"].tolist()) if len(rows) else None


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identified(docs: DataFrame, model: Model | None, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` with the language of each whole text and its score.

    The score is the best language's value between 0 and 1: half of one plus the margin to the next.
    """

    def judge(texts: list[bytes | None]) -> list[pa.Array]:
        if model is None:
            return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
        some = [(t or b"").decode("utf-8", "replace") for t in texts]
        known = np.array([any(map(str.isalpha, t)) for t in some])
        values = model.scores([t or b"" for t in texts])
        best = values.argmax(axis=1)
        ranked = np.sort(values, axis=1)
        margin = ranked[:, -1] - ranked[:, -2] if values.shape[1] > 1 else np.ones(len(texts))
        score = np.where(known, np.round(np.clip(0.5 + margin / 4, 0.0, 1.0), 6), 0.0)
        names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

    return words.per_document(docs, keep, judge, FIELDS, text)
