"""Scoring with an n-gram trie in Elias-Fano form.

The trie has two levels: words, and the successors of each word. A word's successors are a
rising sequence; with the word's rank in front of them all successors of a shard are one
rising sequence, and rising pointers tell where a word's successors begin, and so their number. Words, pointers and
successors are Elias-Fano sequences; the counts of pairs are codes of 8 bits: small counts as they are, larger
ones as logarithms up to the shard's largest count, which is part of the trie. So no probability is cut off,
however often a word occurs. The levels of a shard lie in one file, which is mapped into memory while it is asked.

    p(w | v) = (c(v w) - d) / c(v) + d * s(v) / c(v) * p(w)        p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

with s(v) the number of v's successors and d the share of pairs seen once, n1 / (n1 + 2 n2), of all shards.

The work is cut twice. Documents are dealt by hash to chunks; a chunk reduces its texts to sorted
distinct words and pairs with their training counts and sends each shard its stretch of them, packed. A shard (a range of word
hashes, with the pairs that begin with its words) adds the chunks' counts up, builds its trie
and answers each chunk with counts, numbers of successors and 8-bit codes in the order of the questions. The chunk
meets its documents again, and scores them. The pairs of a word that begins more than two shards' share of them have
places in several shards, by the hash of the successor; the chunk adds up its numbers of successors. Each part
depends on a bounded share of the input, but for rows of equal id and text, which all go to one chunk; there is nothing on the driver
but the input's size and the list of those words. Words are known by 64 bits, and a word's
successors by 40.

Defined results: null texts are empty; an empty text is its end token; null ids are neither
learned from nor held out; equal texts get equal scores; without training text a
word has the probability 1.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import words
from tidewire.llm.elias_fano import EliasFano

#: Bytes of text in a chunk, and words' and pairs' share of a shard, as if it were a chunk.
CHUNK = 16 << 20
#: Bytes of text in which frequent words are counted, and of them in one step.
COUNTED, COUNTED_AT_ONCE = 64 << 20, 1 << 20
ADDED = 0.1
SUCCESSOR_BITS = 40
#: Codes up to here are counts; those above it are spaced evenly, as logarithms, up to the largest count.
EXACT = 64
DEFAULT_DISCOUNT = 0.75
#: What counts are kept and sent in; zstd takes out the zeros above small ones.
COUNT = np.int64
U64 = np.uint64
END = 0xE3D5A1B7C9F08642
START = 0x5B8C3F1E7A2D9046


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).data)


def _unzip(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _narrow(successors: np.ndarray) -> np.ndarray:
    """The upper 40 bits of hashes, as five bytes each."""
    return successors.view(np.uint8).reshape(-1, 8)[:, 3:]


def _wide(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = packed.reshape(-1, 5)
    return out.reshape(-1).view(U64)


class Frequent:
    """Words whose pairs are dealt to several shards: each has some places, whose hashes stand for it in pairs."""

    def __init__(self, hashes: np.ndarray | Sequence[int] = (), places: np.ndarray | Sequence[int] = ()) -> None:
        order = np.argsort(np.asarray(hashes, U64))
        self.hashes, self.places = np.asarray(hashes, U64)[order], np.asarray(places, np.int64)[order]
        self.ends = np.cumsum(self.places)
        self.begins = self.ends - self.places
        nth = np.arange(self.places.sum()) - np.repeat(self.begins, self.places)
        self.all = words.mixed(np.repeat(self.hashes, self.places) ^ words.mixed(nth.astype(U64) + U64(1)))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the frequent words each one is, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


NONE = Frequent()


class Chunk:
    """The distinct words and pairs of some texts, sorted by hash, and where each token has them.

    The places of the frequent words among them are words too, and begin these words' pairs.
    """

    def __init__(self, texts: list[bytes | None], frequent: Frequent = NONE) -> None:
        h, bounds = words.hashes(texts, words.BLANK_LOWER)
        n = np.diff(bounds) + 1
        self.ends = np.cumsum(n)
        self.starts = self.ends - n
        tokens = np.empty(len(h) + len(texts), U64)
        is_end = np.zeros(len(tokens), bool)
        is_end[self.ends - 1] = True
        tokens[is_end], tokens[~is_end] = U64(END), h
        found, place = np.unique(np.concatenate([tokens, np.array([START], U64)]), return_inverse=True)
        number = frequent.number(found)
        dealt = np.flatnonzero(number >= 0)
        n = frequent.places[number[dealt]]
        at = np.repeat(frequent.begins[number[dealt]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.words = np.sort(np.concatenate([found, frequent.all[at]]))
        new = np.searchsorted(self.words, found)
        of_all = np.zeros(len(frequent.all), np.int64)
        of_all[at] = np.searchsorted(self.words, frequent.all[at])
        #: The word itself, or the one whose place it is; and which words are places.
        self.owner = np.arange(len(self.words))
        self.owner[of_all[at]] = np.repeat(new[dealt], n)
        self.is_place = self.owner != np.arange(len(self.words))
        self.word, self.start = new[place[:-1]], new[place[-1]]
        before = np.empty_like(place[:-1])
        before[1:] = place[:-2]
        before[self.starts] = place[-1]
        #: What begins each token's pair: the word before it, or one of its places by the token's hash.
        self.before = new[before]
        if len(dealt):
            some = np.flatnonzero(number[before] >= 0)
            which = number[before[some]]
            nth = words.mixed(tokens[some]) % frequent.places[which].astype(U64)
            self.before[some] = of_all[frequent.begins[which] + nth.astype(np.int64)]
        keys, self.pair = np.unique((self.before.astype(U64) << U64(32)) | self.word.astype(U64), return_inverse=True)
        self.first, self.second = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)

    def counts(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often words (START and places: as the beginning) and pairs occur in the training texts."""
        taken = np.repeat(training, self.ends - self.starts)
        one = np.bincount(self.word[taken], minlength=len(self.words))
        one[self.start] = training.sum()
        begun = np.bincount(self.before[taken], minlength=len(self.words))
        one[self.is_place] = begun[self.is_place]
        return one.astype(COUNT), np.bincount(self.pair[taken], minlength=len(self.first)).astype(COUNT)

    def edges(self, shards: int) -> np.ndarray:
        """Where each shard's words begin, and at last their number."""
        lowest = np.array([-(-(s << 64) // shards) for s in range(shards)], dtype=object)
        return np.concatenate([np.searchsorted(self.words, lowest.astype(U64)), [len(self.words)]])


def _texts(table: pa.Table) -> list[bytes | None]:
    return table.column("text").to_pylist()


def questions(table: pa.Table, shards: int, frequent: Frequent = NONE) -> pa.Table:
    """A row for each shard: a chunk's words and pairs with their training counts, packed."""
    chunk = Chunk(_texts(table), frequent)
    one, two = chunk.counts(table.column("training").to_numpy().astype(bool))
    edges = chunk.edges(shards)
    per_word = np.bincount(chunk.first, minlength=len(chunk.words)).astype(np.uint32)
    pair_edges = np.concatenate([[0], np.cumsum(per_word, dtype=np.int64)])[edges]
    successors = chunk.words[chunk.second]
    rows = {"hashes": [], "ones": [], "lengths": [], "successors": [], "twos": []}
    for a, b, c, d in zip(edges, edges[1:], pair_edges, pair_edges[1:], strict=False):
        rows["hashes"].append(_zip(chunk.words[a:b]))
        rows["ones"].append(_zip(one[a:b]))
        rows["lengths"].append(_zip(per_word[a:b]))
        rows["successors"].append(_zip(_narrow(successors[c:d])))
        rows["twos"].append(_zip(two[c:d]))
    number = table.column("chunk")[0].as_py()
    return pa.table({
        "shard": pa.array(range(shards), pa.int32()),
        "chunk": pa.array([number] * shards, pa.int32()),
        **{name: pa.array(column, pa.binary()) for name, column in rows.items()},
    })


def codes(counts: np.ndarray, most: int) -> np.ndarray:
    """8-bit codes of counts from 1 to ``most``."""
    log = np.log(np.maximum(counts, EXACT) / EXACT) / np.log(max(most, 2 * EXACT) / EXACT)
    return np.where(counts <= EXACT, counts, EXACT + np.rint((255 - EXACT) * log)).astype(np.uint8)


def decoded(codes: np.ndarray, most: int) -> np.ndarray:
    """The counts that codes stand for; 0 is no count."""
    above = EXACT * (max(most, 2 * EXACT) / EXACT) ** (np.arange(1, 256 - EXACT) / (255 - EXACT))
    return np.concatenate([np.arange(EXACT + 1.0), above])[codes]


class Trie:
    """The levels of a shard, in a file that is mapped into memory."""

    LEVELS = ("words", "pointers", "successors")

    @staticmethod
    def write(path: str, hashes: np.ndarray, ones: np.ndarray, first: np.ndarray, successors: np.ndarray, twos: np.ndarray) -> None:
        """Write the trie of trained words (sorted) and pairs (rank of the first, successor; sorted)."""
        low = int(hashes[0]) if len(hashes) else 0
        top = int(hashes[-1]) - low + 1 if len(hashes) else 1
        per_word = np.bincount(first, minlength=len(hashes))
        pointers = np.concatenate([[0], np.cumsum(per_word)])
        relative = (first.astype(U64) << U64(SUCCESSOR_BITS)) | successors
        most = int(twos.max()) if len(twos) else 1
        arrays = [np.array([low, most], U64)]
        for values, universe in (
            (hashes - U64(low), top),
            (pointers, len(first) + 1),
            (relative, max(1, len(hashes)) << SUCCESSOR_BITS),
        ):
            n, width, lower, upper = EliasFano.parts(values, universe)
            arrays += [np.array([n, width], np.int64), lower, upper]
        arrays += [ones, codes(twos, most)]
        with open(path, "wb") as file:
            for array in arrays:
                np.save(file, array, allow_pickle=False)

    def __init__(self, path: str) -> None:
        arrays = list(_mapped(path))
        self.low, self.most = arrays[0][0], int(arrays[0][1])
        for i, name in enumerate(self.LEVELS):
            (n, width), lower, upper = arrays[1 + 3 * i : 4 + 3 * i]
            setattr(self, name, EliasFano(int(n), int(width), lower, upper))
        self.ones, self.twos = arrays[10:]

    def ask(self, hashes: np.ndarray, lengths: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of words, numbers of their successors, and count codes of pairs (for each word some successors)."""
        rank = self.words.find(hashes - self.low)
        rank[hashes < self.low] = -1
        known = rank >= 0
        ones = np.zeros(len(hashes), COUNT)
        ones[known] = self.ones[rank[known]]
        begin, end = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[known], end[known] = self.pointers.get(rank[known]), self.pointers.get(rank[known] + 1)
        spread = end - begin
        # A successor is looked for between its word's pointers.
        of = np.repeat(np.where(spread > 0, np.arange(len(hashes)), -1), lengths)
        asked = np.flatnonzero(of >= 0)
        of = of[asked]
        at = self.successors.find((rank[of].astype(U64) << U64(SUCCESSOR_BITS)) | successors[asked], begin[of], end[of])
        twos = np.zeros(len(successors), np.uint8)
        twos[asked[at >= 0]] = self.twos[at[at >= 0]]
        return ones, spread, twos


def _mapped(path: str) -> Iterator[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    with open(path, "rb") as file:
        end = os.fstat(file.fileno()).st_size
        while file.tell() < end:
            version = np.lib.format.read_magic(file)
            shape, _, kind = np.lib.format.read_array_header_1_0(file) if version == (1, 0) else np.lib.format.read_array_header_2_0(file)
            size = int(np.prod(shape)) * kind.itemsize
            at = file.tell()
            yield np.memmap(path, kind, "r", at, shape) if size else np.zeros(shape, kind)
            file.seek(at + size)


def answers(table: pa.Table, frequent: Frequent = NONE) -> pa.Table:
    """A row for each chunk: a shard's answers, packed, with its training tokens and words."""
    columns = {c: table.column(c).to_pylist() for c in ("hashes", "ones", "lengths", "successors", "twos")}
    hashes = [_unzip(x, U64) for x in columns["hashes"]]
    lengths = [_unzip(x, np.uint32) for x in columns["lengths"]]
    successors = [_wide(_unzip(x, np.uint8)) for x in columns["successors"]]
    all_words, place = np.unique(np.concatenate(hashes), return_inverse=True)
    ones = np.bincount(place, weights=np.concatenate([_unzip(x, COUNT) for x in columns["ones"]]), minlength=len(all_words)).astype(COUNT)
    # Only what occurs in training texts is in the trie.
    twos = np.concatenate([_unzip(x, COUNT) for x in columns["twos"]])
    trained = np.flatnonzero(twos)
    first = np.repeat(place, np.concatenate(lengths).astype(np.int64))[trained]
    ranks = np.cumsum(ones > 0) - 1
    pairs, at = np.unique((ranks[first].astype(U64) << U64(SUCCESSOR_BITS)) | np.concatenate(successors)[trained], return_inverse=True)
    counts = np.bincount(at, weights=twos[trained], minlength=len(pairs)).astype(COUNT)
    known = ones > 0
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "trie")
        Trie.write(
            path, all_words[known], ones[known],
            (pairs >> U64(SUCCESSOR_BITS)).astype(np.int64), pairs & U64((1 << SUCCESSOR_BITS) - 1), counts,
        )
        trie = Trie(path)
        most = trie.most
        replies = [[_zip(a) for a in trie.ask(*asked)] for asked in zip(hashes, lengths, successors, strict=True)]
        del trie
    no_word = (all_words == U64(START)) | np.isin(all_words, frequent.all)
    return pa.table({
        "chunk": table.column("chunk"),
        "shard": table.column("shard"),
        "tokens": pa.array([int(ones[~no_word].sum())] * len(replies), pa.int64()),
        "words": pa.array([int((known & ~no_word).sum())] * len(replies), pa.int64()),
        "ones": pa.array([r[0] for r in replies], pa.binary()),
        "spread": pa.array([r[1] for r in replies], pa.binary()),
        "twos": pa.array([r[2] for r in replies], pa.binary()),
        "most": pa.array([most] * len(replies), pa.int64()),
        "once": pa.array([int((counts == 1).sum())] * len(replies), pa.int64()),
        "twice": pa.array([int((counts == 2).sum())] * len(replies), pa.int64()),
    })


def scores(docs: pa.Table, replies: pa.Table, frequent: Frequent = NONE) -> pa.Table:
    """The scores of a chunk's documents from the shards' answers."""
    if not docs.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in SCORES})
    chunk = Chunk(_texts(docs), frequent)
    replies = replies.sort_by("shard")

    def joined(name: str, kind: type) -> np.ndarray:
        return np.concatenate([_unzip(x, kind) for x in replies.column(name).to_pylist()])

    one, spread = joined("ones", COUNT), joined("spread", np.int64)
    first = chunk.owner[chunk.first]
    spread = np.bincount(chunk.owner, weights=spread, minlength=len(one))
    n, v = sum(replies.column("tokens").to_pylist()), sum(replies.column("words").to_pylist())
    alone = (one + ADDED) / (n + ADDED * (v + 1))
    n1, n2 = sum(replies.column("once").to_pylist()), sum(replies.column("twice").to_pylist())
    discount = n1 / (n1 + 2.0 * n2) if n1 and n2 else DEFAULT_DISCOUNT
    two = np.concatenate([decoded(_unzip(r["twos"], np.uint8), r["most"]) for r in replies.select(["twos", "most"]).to_pylist()])
    total, next_ = np.maximum(one, 1)[first], alone[chunk.second]
    both = np.where(
        spread[first] > 0,
        (np.maximum(two - discount, 0.0) + discount * spread[first] * next_) / total, next_,
    )

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, chunk.starts)  # every document has its end token

    rows = docs.num_rows
    return pa.table({
        "doc_id": docs.column("doc_id"),
        "held_out": docs.column("held_out"),
        "n_tokens": pa.array(chunk.ends - chunk.starts, pa.int64()),
        "n_known": pa.array(summed((one[chunk.word] > 0).astype(np.int64)), pa.int64()),
        "train_tokens": pa.array([n] * rows, pa.int64()),
        "base_score": pa.array(summed(np.log10(alone)[chunk.word]), pa.float64()),
        "score": pa.array(summed(np.log10(both)[chunk.pair]), pa.float64()),
    })


def frequent_words(docs: DataFrame, size: int, parts: int) -> Frequent:
    """Words (START too) that begin more than two shards' share of the pairs, with a place for each share.

    They are counted in texts of about COUNTED bytes drawn by hash: the list decides where pairs are
    summed, not what comes out. It has fewer than 2 * parts places.
    """
    if parts < 3:
        return NONE
    draw = F.pmod(F.xxhash64(F.lit("frequent"), F.xxhash64("text")), F.lit(1 << 20))
    drawn = docs.filter(draw < F.lit(max(1, min(1 << 20, COUNTED * (1 << 20) // size))))
    least = 1.0 / parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, end in words.parts(lengths, COUNTED_AT_ONCE):
                h, _ = words.hashes(batch.column(0).slice(start, end - start).to_pylist(), words.BLANK_LOWER)
                found, n = np.unique(np.concatenate([h, np.full(end - start, START, U64)]), return_counts=True)
                total = int(n.sum())
                some = n >= least * total
                # The row of the word 0 has what all of them are a share of.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(found[some].view(np.int64), 0)), pa.array(np.append(n[some], total))], names=["word", "n"]
                )

    rows = words.small_batches(drawn.select("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r.word: r.n for r in rows.orderBy(F.desc("n"), "word").limit(parts + 1).collect()}
    total = n.pop(0, 0)
    share = {word: count * parts / total for word, count in n.items() if count * parts > 2 * total}
    return Frequent(np.array(list(share), np.int64).view(U64), [int(x) + 1 for x in share.values()])


SCORES = (
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
)


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each document.

    Documents whose id's crc32 is 0 modulo 10 are held out; the others are learned from.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes")).first()["bytes"] or 0
    parts = max(1, -(-size // chunk_bytes))
    rest = F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(10)
    rows = words.small_batches(docs).select(
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(parts)).cast("int").alias("chunk"),
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(rest == 0, F.lit(False)).alias("held_out"),
        F.coalesce(rest != 0, F.lit(False)).alias("training"),
        F.col(text).cast("string").cast("binary").alias("text"),
    )
    frequent = frequent_words(rows, size, parts)
    asked = rows.groupBy("chunk").applyInArrow(
        lambda table: questions(table, parts, frequent),
        "shard int, chunk int, hashes binary, ones binary, lengths binary, successors binary, twos binary",
    )
    replied = asked.groupBy("shard").applyInArrow(
        lambda table: answers(table, frequent),
        "chunk int, shard int, tokens long, words long, ones binary, spread binary, twos binary, most long, once long, twice long",
    )
    # Both reads of the documents come from one exchange by chunk.
    return (
        rows.groupBy("chunk")
        .cogroup(replied.groupBy("chunk"))
        .applyInArrow(
            lambda docs, replies: scores(docs, replies, frequent),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
