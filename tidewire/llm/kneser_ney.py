"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of words.

The model predicts a text's next word from the ORDER - 1 before it, over all words it has met. Words are those of
``words.ALNUM``, characters in scripts without blanks; a text begins after ORDER - 1 starts and is closed by an end,
which is predicted too. Half of the trusted texts, by their hash, are learned from; the others set the limits, so a
limit is a value of texts the model has not seen, and copies of a text are all on one side.

Learning is counting: each task reduces its texts to n-gram counts, and these are summed by n-gram. A lower
order counts in how many ways an n-gram continues; a context knows its total and how many of its
n-grams were seen once, twice and more often. Discounts come from the counts of counts of all n-grams. An n-gram goes by Spark's ``xxhash64``
of its words, which tasks compute with array operations; two of them share a name with a chance of 2^-64.

Scoring joins documents with these counts by shard. Tasks put whole texts into chunks of about CHUNK_WORDS words, and ask for each
chunk's distinct n-grams once; those that a bitmap of the learned ones does not have are not asked for. Questions and
answers are packed, a row for each chunk and shard; a shard holds about PER_SHARD facts, and its questions are split into
parts of about PART_BYTES. So a task holds a chunk, or a shard and a part, and the longest text. There are never more rows than questions.
Documents are scored in ROUNDS parts, by a hash of id and text, one after the other: chunks and questions of one round are
on disk at a time, and counts go as soon as the facts are stored.

A document is rated by its perplexity as if CENTRED more words of the median of trusted documents belonged to it,
so that a few words alone decide nothing. It is kept when this is at most the QUANTILE of the trusted documents
of its language that were not learned from. A language with fewer than LEAST_TRUSTED of them gets the value of all languages.

Defined results: null texts and texts without a word have no perplexity and are not kept; a document with
several labels is trusted if none denies its quality; null ids are not trusted; null is a language
of its own; equal texts have equal perplexities; without trusted text every other document is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import words
from tidewire.llm.bitmaps import Bitmap, bitmap
from tidewire.llm.tables import Passing, checked_broadcast, shuffles_freed

ORDER = 2
QUANTILE = 0.995
LEAST_TRUSTED = 50
CENTRED = 16
#: Bytes of text that one table of counts takes up before it is merged, and n-grams that a task holds.
COUNTED_AT_ONCE = 4 << 20
MOST_HELD = 1 << 20
CHUNK_WORDS = 1 << 19
PER_SHARD = 1 << 19
PART_BYTES = 32 << 20
BITMAP_BITS = 26
ROUNDS = 4

U64 = np.uint64
START, END = U64(1), U64(2)

# The primes and the seed of Spark's xxhash64.
_P1, _P2, _P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
_P4, _P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)
_SEED = U64(42)

Padded = tuple[np.ndarray, np.ndarray, np.ndarray]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def hashed(value: np.ndarray, seed: np.ndarray | np.uint64 = _SEED) -> np.ndarray:
    """Spark's ``xxhash64`` of each number, after the columns that gave ``seed``."""
    h = _turned(value * _P2, 31) * _P1 ^ (seed + (_P5 + U64(8)))
    h = _turned(h, 27) * _P1 + _P4
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def names(tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """For k from 1 to ``order``, the names of the k words that begin at each place."""
    out: list[np.ndarray] = []
    for k in range(order):
        out.append(hashed(tokens[k:], out[-1][: len(tokens) - k]) if out else hashed(tokens))
    return out


def padded(h: np.ndarray, bounds: np.ndarray, order: int) -> Padded:
    """Words of all texts between starts and ends, the places that are predicted, and how many each text has.

    A text without a word has no places.
    """
    counts = np.diff(bounds)
    some = counts > 0
    lengths = np.where(some, counts + order, 0)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    tokens = np.full(int(lengths.sum()), START, U64)
    predicted = np.where(some, counts + 1, 0)
    places = np.arange(int(predicted.sum())) + np.repeat(begins + order - 1 - (np.cumsum(predicted) - predicted), predicted)
    tokens[places] = END
    inner = np.ones(len(places), bool)
    inner[np.cumsum(predicted)[some] - 1] = False
    tokens[places[inner]] = h
    return tokens, places, predicted


def split(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and where each text's words begin."""
    return words.hashes(texts, words.ALNUM, by_character=True)


def _columns(order: int) -> list[str]:
    return [f"w{i}" for i in range(order)]


def counted(docs: DataFrame, text: str = "text", order: int = ORDER) -> DataFrame:
    """Rows (w0, ..., n): how often each n-gram of ``order`` words occurs in all texts."""
    rows = docs.select(F.col(text).cast("string").cast("binary").alias("text"))
    columns = _columns(order)
    found_type = tuple[np.ndarray, np.ndarray, np.ndarray]

    def table(texts: list[bytes | None]) -> found_type:
        tokens, places, _ = padded(*split(texts), order)
        keys, at, n = np.unique(names(tokens, order)[-1][places - order + 1], return_index=True, return_counts=True)
        return keys, np.stack([tokens[places[at] - order + 1 + i] for i in range(order)], axis=1), n

    def merged(parts: list[found_type]) -> found_type:
        keys, at, place = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([p[2] for p in parts]), minlength=len(keys)).astype(np.int64)
        return keys, np.concatenate([p[1] for p in parts])[at], n

    def batches_of(found: found_type) -> Iterator[pa.RecordBatch]:
        _, grams, n = found
        for at in range(0, len(n), 1 << 16):
            some = slice(at, at + (1 << 16))
            arrays = [pa.array(grams[some, i].view(np.int64)) for i in range(order)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n[some])], names=[*columns, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[found_type] = []
        for batch in batches:
            texts = batch.column(0)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in words.parts(lengths, COUNTED_AT_ONCE):
                found.append(table(texts.slice(start, end - start).to_pylist()))
                if sum(len(f[0]) for f in found) >= 2 * MOST_HELD:
                    found = [merged(found)]
                    if len(found[0][0]) >= MOST_HELD:
                        yield from batches_of(found.pop())
        if found:
            yield from batches_of(merged(found))

    schema = ", ".join(f"{c} long" for c in [*columns, "n"])
    return words.small_batches(rows).mapInArrow(run, schema).groupBy(*columns).agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of 1, of 2, and of 3 or more."""
    if not (n1 and n2):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2.0 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), most) for d, most in zip(raw, (0.95, 1.9, 2.85), strict=True))


#: What is known of an n-gram: its count; as a context its total, and its n-grams seen once, twice, more often.
FACTS = ("n", "total", "once", "twice", "more")


class Model:
    """Facts by shard, and the numbers that every task needs: discounts by order, words, and their total."""

    def __init__(self, docs: DataFrame, text: str = "text", order: int = ORDER) -> None:
        self.order = order
        passing = [Passing(counted(docs, text, order), "grams")]
        counts = passing[0].rows
        self.taken: list[tuple[float, float, float]] = []
        zero = F.lit(0).cast("long")
        seen = [F.count(F.when(c, 1)) for c in (F.col("n") == 1, F.col("n") == 2, F.col("n") > 2)]
        parts, types = [], 0
        for k in range(order, 0, -1):
            columns = _columns(k)
            spread = counts.agg(
                *[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)],
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), F.count(F.when(F.col("n") > 2, 1)).alias("more"),
            ).first()
            types += spread["types"]
            self.taken.insert(0, discounts(spread["n1"], spread["n2"], spread["n3"], spread["n4"]))
            parts.append(counts.select(F.xxhash64(*columns).alias("gram"), F.col("n"), *[zero.alias(f) for f in FACTS[1:]]))
            if k > 1:
                context = counts.groupBy(*columns[:-1]).agg(F.sum("n").alias("total"), *[c.alias(f) for c, f in zip(seen, FACTS[2:], strict=True)])
                parts.append(context.select(F.xxhash64(*columns[:-1]).alias("gram"), zero.alias("n"), *FACTS[1:]))
                # In how many ways the shorter n-gram continues one before it.
                shorter = [F.col(c).alias(columns[i]) for i, c in enumerate(columns[1:])]
                passing.append(Passing(counts.groupBy(*shorter).agg(F.count(F.lit(1)).alias("n")), "continuations"))
                counts = passing[-1].rows
        once, twice, more = self.taken[0]
        self.total = int(spread["total"] or 0)
        left = once * spread["n1"] + twice * spread["n2"] + more * spread["more"]
        #: The probability of a word never met, and of every word before its own share.
        self.floor = (left / self.total if self.total else 1.0) / (spread["types"] + 1)
        facts = parts[0]
        for part in parts[1:]:
            facts = facts.unionByName(part)
        self.shard_bits = max(3, math.ceil(math.log2(max(types / PER_SHARD, 1))))
        #: One row a shard: its names in order, and what is known of them.
        self.facts = Passing(_by_shard(facts, self.shard_bits), "facts").rows
        for table in passing:
            table.remove()
        with shuffles_freed(docs.sparkSession):
            self.known = bitmap(_grams(self.facts), BITMAP_BITS)


def _by_shard(facts: DataFrame, shard_bits: int) -> DataFrame:
    """Rows (shard, grams, facts): all facts of a shard, packed; those of one name are added."""

    def packed(rows: pa.Table) -> pa.Table:
        grams = rows["gram"].to_numpy().view(U64)
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        known = np.stack([np.add.reduceat(rows[f].to_numpy()[order], first) for f in FACTS])
        return pa.table({
            "shard": pa.array([rows["shard"][0].as_py()], pa.int32()),
            "grams": pa.array([_packed(np.diff(grams[first], prepend=U64(0)))], pa.binary()),
            "facts": pa.array([_packed(known)], pa.binary()),
        })

    shard = F.shiftrightunsigned("gram", 64 - shard_bits).cast("int")
    return facts.withColumn("shard", shard).groupBy("shard").applyInArrow(packed, "shard int, grams binary, facts binary")


def _grams(facts: DataFrame) -> DataFrame:
    """Rows (gram) from the packed facts."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                grams = np.cumsum(_unpacked(data.as_py()), dtype=U64).view(np.int64)
                for at in range(0, len(grams), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + (1 << 16)])], names=["gram"])

    return facts.select("grams").mapInArrow(unpacked, "gram long")


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte, so that upper bytes that are zero take nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(U64)


def asked(tokens: np.ndarray, order: int, known: Bitmap) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct names, in order, that may be known; and the names by order and place."""
    named = names(tokens, order)
    return np.unique(np.concatenate([n[known.has(n)] for n in named])), named


def _batch_bytes(arrays: list[pa.Array], columns: list[str]) -> bytes:
    batch = pa.RecordBatch.from_arrays(arrays, names=columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _questions(docs: DataFrame, model: Model, keep: Sequence[str], text: str) -> DataFrame:
    """Rows (chunk, shard, data): a chunk's kept columns and words (shard -1), and its questions by shard."""
    order, shift = model.order, U64(64 - model.shard_bits)
    sent = docs.sparkSession.sparkContext.broadcast(model.known)
    columns = [f"kept {i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, columns, strict=True)], F.col(text).cast("string").cast("binary").alias("text"))

    def chunk_rows(chunk: int, held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[1] for x in held])
        counts = np.concatenate([np.diff(x[2]) for x in held])
        # Words that are not known all count as one that is not.
        vocabulary, index, uses = np.unique(h, return_inverse=True, return_counts=True)
        there = sent.value.has(hashed(vocabulary))
        # Frequent words have small numbers, which take less room.
        falling = np.argsort(-uses[there], kind="stable")
        ranks = np.zeros(len(vocabulary), np.uint32)
        ranks[np.flatnonzero(there)[falling]] = np.arange(1, len(falling) + 1, dtype=np.uint32)
        number = ranks[index]
        vocabulary = np.concatenate([np.zeros(1, U64), vocabulary[there][falling]])
        tokens, _, _ = padded(vocabulary[number], np.concatenate([[0], np.cumsum(counts)]), order)
        wanted, _ = asked(tokens, order, sent.value)
        kept = [pa.concat_arrays([x[0][i] for x in held]) for i in range(len(columns))]
        parts = [
            _batch_bytes([*kept, pa.array(counts)], [*columns, "n"]),
            _batch_bytes([pa.array(vocabulary)], ["vocabulary"]),
            _batch_bytes([pa.array((number >> np.uint32(8 * i)).astype(np.uint8)) for i in range(4)], [f"byte{i}" for i in range(4)]),
        ]
        sizes = np.array([len(p) for p in parts], "<i8").tobytes()
        shards, data = [-1], [sizes + b"".join(parts)]
        owner = (wanted >> shift).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(wanted)]]) if len(wanted) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            shards.append(int(owner[a]))
            data.append(_packed(np.diff(wanted[a:b], prepend=U64(0))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(shards), pa.int64()), pa.array(shards, pa.int32()), pa.array(data, pa.binary())],
            names=["chunk", "shard", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in words.parts(lengths):
                h, bounds = split(texts.slice(start, end - start).to_pylist())
                held.append(([c.slice(start, end - start) for c in batch.columns[:-1]], h, bounds))
                n += len(h)
                if n >= CHUNK_WORDS:
                    yield from chunk_rows(chunk, held)
                    held, n, chunk = [], 0, chunk + 1
        if held:
            yield from chunk_rows(chunk, held)

    return words.small_batches(rows).mapInArrow(run, "chunk long, shard int, data binary")


def _answers(questions: DataFrame, model: Model) -> DataFrame:
    """Rows (chunk, shard, data): the facts that answer each row of questions."""
    shards = 1 << model.shard_bits
    total = questions.agg(F.sum(F.length("data")).alias("bytes")).first()["bytes"] or 0
    parts = math.ceil(total / shards / PART_BYTES) or 1
    facts = model.facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked_for = questions.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, known = np.zeros(0, U64), np.zeros((len(FACTS), 0), np.int64)
        if left.num_rows:
            grams = np.cumsum(_unpacked(left["grams"][0].as_py()), dtype=U64)
            known = _unpacked(left["facts"][0].as_py()).view(np.int64).reshape(len(FACTS), -1)
        out = []
        for data in right["data"]:
            wanted = np.cumsum(_unpacked(data.as_py()), dtype=U64)
            at = np.minimum(np.searchsorted(grams, wanted), max(len(grams) - 1, 0))
            hit = grams[at] == wanted if len(grams) else np.zeros(len(wanted), bool)
            found = np.zeros((len(FACTS), len(wanted)), np.int64)
            found[:, hit] = known[:, at[hit]]
            out.append(_packed(found))
        return pa.table({"chunk": right["chunk"], "shard": right["shard"], "data": pa.array(out, pa.binary())})

    return (
        facts.groupBy("shard", "part")
        .cogroup(asked_for.groupBy("shard", "part"))
        .applyInArrow(answered, "chunk long, shard int, data binary")
    )


def log_probabilities(tokens: np.ndarray, places: np.ndarray, wanted: np.ndarray, named: list[np.ndarray], facts: np.ndarray, model: dict) -> np.ndarray:
    """log10 of the probability of the word at each place after the words before it.

    ``facts`` has a column for each wanted name, and a last one of zeros for names nobody asked for.
    """
    p = np.full(len(places), model["floor"])
    context = np.zeros(0, np.int64)
    for k, taken in enumerate(model["taken"], 1):
        at = np.searchsorted(wanted, named[k - 1])
        at[np.append(wanted, U64(0))[at] != named[k - 1]] = len(wanted)
        n = facts[0][at[places - k + 1]]
        own = n - np.array([0.0, *taken])[np.minimum(n, 3)]
        if k == 1:
            p += own / max(model["total"], 1)
        else:
            total = facts[1][context]
            weights = np.divide(facts[2:].T @ np.array(taken), facts[1], out=np.ones(facts.shape[1]), where=facts[1] > 0)
            p = weights[context] * p + own / np.maximum(total, 1)
        if k < len(model["taken"]):
            context = at[places - k]
    return np.log10(p)


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("perplexity", T.DoubleType())]


def with_perplexity(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep`` with words and perplexity (for each predicted word) of each whole text, stored."""
    turn = F.pmod(F.xxhash64(*keep, text), F.lit(rounds))
    out: DataFrame | None = None
    for i in range(rounds):
        questions = Passing(_questions(docs.filter(turn == i), model, keep, text), "questions")
        scores = Passing(_scored(questions.rows, model, [docs.schema[c] for c in keep]), "perplexity").rows
        questions.remove()
        out = scores if out is None else out.unionByName(scores)
    return out


def _scored(rows: DataFrame, model: Model, keep: list[T.StructField]) -> DataFrame:
    """The kept columns of the chunks in ``rows``, with words and perplexity."""
    sent = rows.sparkSession.sparkContext.broadcast(model.known)
    order, numbers = model.order, {"floor": model.floor, "taken": model.taken, "total": model.total}
    schema = T.StructType(keep + FIELDS)
    columns = [f.name for f in schema]
    answers = _answers(rows.filter(F.col("shard") >= 0), model)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        data = left["data"][0].as_py()
        ends = 24 + np.cumsum(np.frombuffer(data[:24], "<i8"))
        kept, vocabulary, numbered = (
            pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data[a:b])).read_all()
            for a, b in zip([24, *ends[:-1]], ends, strict=True)
        )
        counts = kept["n"].to_numpy()
        number = sum(numbered[f"byte{i}"].to_numpy().astype(np.uint32) << np.uint32(8 * i) for i in range(4))
        tokens, places, predicted = padded(vocabulary["vocabulary"].to_numpy()[number], np.concatenate([[0], np.cumsum(counts)]), order)
        wanted, named = asked(tokens, order, sent.value) if len(tokens) else (np.zeros(0, U64), [])
        by_shard = np.argsort(right["shard"].to_numpy())
        facts, at = np.zeros((len(FACTS), len(wanted) + 1), np.int64), 0
        for i in by_shard.tolist():
            found = _unpacked(right["data"][i].as_py()).view(np.int64).reshape(len(FACTS), -1)
            facts[:, at : at + found.shape[1]] = found
            at += found.shape[1]
        sums = np.zeros(1)
        if len(places):
            sums = np.concatenate([sums, np.cumsum(log_probabilities(tokens, places, wanted, named, facts, numbers))])
        stops = np.cumsum(predicted)
        if at != len(wanted):
            raise RuntimeError(f"{len(wanted)} questions have {at} answers")
        value = 10.0 ** (-(sums[stops] - sums[stops - predicted]) / np.maximum(predicted, 1))
        old = [kept[f"kept {i}"] for i in range(len(keep))]
        return pa.table([*old, kept["n"], pa.array(np.round(value, 6), mask=counts == 0)], names=columns)

    held = rows.filter(F.col("shard") < 0)
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Rows (trusted): ids of the documents whose labels all say that their quality is good."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("trusted"))
        .agg(F.min("quality").alias("least"))
        .filter(F.col("least") >= 1)
        .select("trusted")
    )


def learned_from(text: str = "text") -> Column:
    """Whether a trusted text is learned from; the others set the limits."""
    return F.pmod(F.xxhash64(F.col(text)), F.lit(2)) == 0


def _quantile(of: Column) -> Column:
    return F.percentile_approx(of, F.lit(QUANTILE), F.lit(10_000))


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """Rows (doc_id, lang, learned, n_words, perplexity, rated, threshold, kept), one for each document.

    ``learned`` says whether the model would learn from the text if it were trusted.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(learned_from(text), F.lit(False)).alias("learned"),
        F.col(text).alias("text"),
    )
    good = checked_broadcast(trusted_ids(labels), "trusted")
    trusted = rows.filter("learned").join(good, F.col("doc_id") == F.col("trusted"), "left_semi")
    model = Model(trusted, order=order)
    scores = with_perplexity(rows, model, ["doc_id", "lang", "learned"])
    judged = scores.filter(~F.col("learned") & F.col("perplexity").isNotNull()).join(good, F.col("doc_id") == F.col("trusted"), "left_semi")
    centre = judged.agg(F.percentile_approx("perplexity", F.lit(0.5), F.lit(10_000)).alias("centre")).first()["centre"]

    def rated(df: DataFrame) -> DataFrame:
        known = (F.col("n_words") + 1) * F.log10("perplexity") + F.lit(CENTRED * math.log10(centre or 1.0))
        return df.withColumn("rated", F.pow(F.lit(10.0), known / (F.col("n_words") + F.lit(1 + CENTRED))))

    of_trusted = rated(judged)
    overall = of_trusted.agg(_quantile(F.col("rated")).alias("limit")).first()["limit"]
    limits = (
        of_trusted.groupBy(F.col("lang").alias("of_lang"))
        .agg(_quantile(F.col("rated")).alias("limit"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= LEAST_TRUSTED)
        .select("of_lang", "limit")
    )
    threshold = F.coalesce(F.col("limit"), F.lit(overall), F.lit(float("inf")))
    return (
        rated(scores)
        .join(checked_broadcast(limits, "limits", 10_000), F.col("lang").eqNullSafe(F.col("of_lang")), "left")
        .withColumn("threshold", threshold)
        .withColumn("kept", F.coalesce(F.col("rated") <= F.col("threshold"), F.lit(False)))
        .select("doc_id", "lang", "learned", "n_words", "perplexity", "rated", "threshold", "kept")
    )
