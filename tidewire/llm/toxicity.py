"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and digits and signs
that stand for letters to those letters, and turns the rest of ASCII into single blanks. Lexicon entries
are word beginnings, so one entry covers the forms of a word. An entry inside an
exception phrase does not count. A text's score comes from the weights found, as a sum and per
word, through a logistic curve.

The lexicon holds the seed words below and the word beginnings that mark toxic training
documents; weights are log odds. Both lexicon and curve are fitted on the driver to at most
MOST_TOXIC + MOST_CLEAN labelled documents of at most LONGEST_SAMPLE characters, drawn by a
hash of their ids; scores cover whole texts of all documents.

Defined results: null and empty texts match nothing and get the curve's lowest score; labels of
null, and documents without a label or an id, are not learned from; a document with several labels
counts as toxic if one says so; of rows of one id the least text is learned from; equal texts get equal scores; without any toxic or any clean
document to learn from, the curve is DEFAULT_CURVE.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import words

# Insults, and phrases in which such a word is harmless.
SEED_WORDS = (
    "idiot moron stupid imbecile scum trash garbage loser clown pathetic worthless disgusting "
    "dumbass asshole bastard bitch retard cretin scumbag"
).split()
EXCEPTIONS = (
    "clown fish", "clownfish", "circus clown", "trash can", "trash bin", "trash bag", "garbage can",
    "garbage collector", "garbage collection", "loser bracket", "scumble",
)

# Letters of other scripts that look like Latin ones, and signs used for letters.
HOMOGLYPHS = str.maketrans(
    "авекмнорстухіјѕԁԛ"
    "αβεηικνορτυχı",
    "abekmhopctyxijsdq"
    "abenikvoptuxi",
)
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

MOST_TOXIC = 4000
MOST_CLEAN = 6000
LONGEST_SAMPLE = 60_000
#: Word beginnings: lengths, least toxic documents (as number and part), least log odds, and how many at most.
BEGINNINGS = range(3, 11)
LEAST_DOCUMENTS = 5
LEAST_PART = 0.005
LEAST_ODDS = 3.0
#: Entries that a toxic document can have before it no longer speaks for further ones.
COVERS = 3
MOST_ENTRIES = 2000
#: Words that a text has besides its own when weights are taken per word.
EXTRA_WORDS = 50
SEED_WEIGHT = 5.0
THRESHOLD = 0.7
# Constant, and factors of the logarithms of weight and weight per 100 words.
DEFAULT_CURVE = (-3.0, 1.5, 1.0)


def _table() -> dict[int, str]:
    table = {i: chr(i) if chr(i).isalnum() else " " for i in range(128)}
    table |= {ord(sign): letter for sign, letter in SIGNS.items()}
    table |= {0xFF01 + i: table[0x21 + i] for i in range(94)}  # full-width forms
    table |= {i: " " for i in (0xA0, *range(0x2000, 0x200B), *range(0x2010, 0x2028), 0x202F, 0x3000)}
    table |= {i: "" for i in (0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF)}  # invisible
    return table | HOMOGLYPHS


_FOLD = _table()


def folded(text: str) -> str:
    """The text's folded words, each with one blank before it."""
    parts = text.lower().translate(_FOLD).split()
    return " " + " ".join(parts) if parts else ""


@dataclass(frozen=True)
class Model:
    """Word beginnings with weights, exception phrases, and the curve from weights to scores."""

    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


@functools.lru_cache(maxsize=4)
def _automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase in exceptions:
        automaton.add_word(f" {phrase}", (len(phrase) + 1, None))
    for beginning, weight in lexicon:
        automaton.add_word(f" {beginning}", (len(beginning) + 1, weight))
    automaton.make_automaton()
    return automaton


def weight_found(text: str, lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> tuple[float, int]:
    """Sum of the weights of a folded text's words (the greatest for each word), and its words."""
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (length, weight) in _automaton(lexicon, exceptions).iter(text):
        start = end - length + 1
        if weight is None:
            safe.append((start, end))
        else:
            best[start] = max(best.get(start, 0.0), weight)
    for first, last in safe:
        for start in [s for s in best if first <= s <= last]:
            del best[start]
    return sum(best.values()), text.count(" ")


def features(weight: float, n_words: int) -> tuple[float, float, float]:
    return 1.0, math.log1p(weight), math.log1p(100.0 * weight / (n_words + EXTRA_WORDS))


def learned_lexicon(toxic: Sequence[str], clean: Sequence[str]) -> dict[str, float]:
    """Word beginnings that mark toxic documents, with their log odds, from folded texts.

    Of beginnings that occur in the same documents the longest counts. They are taken by how many
    toxic documents they add to those that have COVERS entries already, so that
    words which merely come along in some copies of a document are left out.
    """

    def beginnings(text: str) -> set[str]:
        return {w[:n] for w in set(text.split()) for n in BEGINNINGS if len(w) >= n}

    least = max(LEAST_DOCUMENTS, math.ceil(LEAST_PART * len(toxic)))
    bad: Counter[str] = Counter()
    # Length by length: only what begins like a frequent one can be frequent.
    for n in BEGINNINGS:
        found: Counter[str] = Counter()
        for text in toxic:
            found.update({w[:n] for w in set(text.split()) if len(w) >= n and (n == BEGINNINGS[0] or w[: n - 1] in bad)})
        bad.update({b: count for b, count in found.items() if count >= least})
    good: Counter[str] = Counter()
    for text in clean:
        good.update(beginnings(text) & bad.keys())
    longer: Counter[str] = Counter()
    for b, n in bad.items():
        longer[b[:-1]] = max(longer[b[:-1]], n)
    odds = {
        b: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((good[b] + 0.5) / (len(clean) + 1))
        for b, n in bad.items()
        if longer[b] < 0.98 * n
    }
    odds = {b: x for b, x in odds.items() if x >= LEAST_ODDS}
    # A longer one that says much more in nearly as many documents replaces a shorter one.
    for b, x in list(odds.items()):
        for n in BEGINNINGS:
            if n < len(b) and bad[b] >= 0.8 * bad[b[:n]] and x >= odds.get(b[:n], x) + 1.0:
                del odds[b[:n]]
    where: dict[str, set[int]] = {b: set() for b in odds}
    for number, text in enumerate(toxic):
        for b in beginnings(text) & where.keys():
            where[b].add(number)
    covers: Counter[int] = Counter()
    chosen: dict[str, float] = {}
    queue = [(-len(own), -len(b), b) for b, own in where.items()]
    heapq.heapify(queue)
    while queue and len(chosen) < MOST_ENTRIES:
        size, length, b = heapq.heappop(queue)
        adds = sum(covers[number] < COVERS for number in where[b])
        if adds < least:
            continue
        if adds < -size:  # it was counted before others were taken
            heapq.heappush(queue, (-adds, length, b))
            continue
        if any(chosen.get(b[:n], 0.0) >= odds[b] - 0.5 for n in BEGINNINGS if n < len(b)):
            continue  # a shorter one says the same
        chosen[b] = odds[b]
        covers.update(where[b])
    return chosen


def fitted_curve(rows: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a slight pull towards 0, by Newton's method."""
    if not 0 < labels.sum() < len(labels):
        return DEFAULT_CURVE
    pull = np.diag([1e-3, 1e-1, 1e-1])
    curve = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ curve, -30, 30)))
        slope = rows.T @ (labels - p) - pull @ curve
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + pull + 1e-9 * np.eye(3), slope)
        size = np.abs(step).max()
        curve = curve + step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return tuple(float(x) for x in curve)


def fit(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """The model of some labelled texts."""
    split = list(dict.fromkeys((folded(t), y) for t, y in sorted(zip(texts, labels, strict=True))))
    found = learned_lexicon([t for t, y in split if y], [t for t, y in split if not y])
    lexicon = tuple(sorted({**{w: SEED_WEIGHT for w in SEED_WORDS}, **found}.items()))
    exceptions = tuple(sorted(EXCEPTIONS))
    rows = np.array([features(*weight_found(t, lexicon, exceptions)) for t, _ in split]).reshape(-1, 3)
    return Model(lexicon, exceptions, fitted_curve(rows, np.array([float(y) for _, y in split])))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are not learned from; null ids are never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(3) == F.lit(1), F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most about MOST_TOXIC + MOST_CLEAN rows (text, toxic) to learn from, drawn by hash."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    )
    n_toxic, n = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, MOST_TOXIC / max(1, n_toxic)))).otherwise(
        F.lit(min(1.0, MOST_CLEAN / max(1, n - n_toxic)))
    )
    drawn = F.xxhash64(F.lit("toxicity"), F.col("labelled"))
    chance = F.pmod(drawn, F.lit(1 << 20)) / F.lit(float(1 << 20))
    ids = known.filter(chance < rate).orderBy(drawn, "labelled").limit(2 * (MOST_TOXIC + MOST_CLEAN))
    return (
        docs.filter(F.col("text").isNotNull() & (F.length("text") <= LONGEST_SAMPLE))
        .select(F.col("doc_id").alias("labelled"), "text")
        # The ids that were drawn have a bound, so the texts need not move.
        .join(F.broadcast(ids), "labelled")
        .groupBy("labelled", "toxic")
        .agg(F.min("text").alias("text"))
        .select("text", "toxic")
    )


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels).toPandas()
    return fit(rows["text"].tolist(), rows["toxic"].tolist())


FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("n_words", T.LongType()),
]


def scored(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with score, weight found and words of each whole text."""

    def judge(texts: list[bytes | None]) -> list[pa.Array]:
        found = [
            weight_found(folded((t or b"").decode("utf-8", "replace")), model.lexicon, model.exceptions) for t in texts
        ]
        rows = np.array([features(*f) for f in found]).reshape(-1, 3)
        scores = 1 / (1 + np.exp(-np.clip(rows @ np.array(model.curve), -30, 30)))
        return [
            pa.array(np.round(scores, 6)),
            pa.array([f[0] for f in found], pa.float64()),
            pa.array([f[1] for f in found], pa.int64()),
        ]

    return words.per_document(docs, keep, judge, FIELDS, text)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their own columns.

    The columns pass through as one struct, so none can clash with a result's name.
    """
    packed = docs.select(F.struct("*").alias("row"), "text")
    return scored(packed, learn(docs, labels), ["row"]).filter(F.col("score") < threshold).select("row.*")
