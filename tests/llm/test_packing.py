"""Packing: exact round trips, and windows against a plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import ODD

from tidewire.llm import packing, token_ids
from tidewire.llm import queries as llm

OP13 = llm.queries()["op13_retrieval_packing"]
SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_of_words_are_those_of_texts():
    rng = random.Random(1)
    parts = ["a", "B", "$", "%&", "?!'", "-", "_", "`", "é.", "×.", "—,", "é", "é", "́", "Σ", "ς", "İ", "ß", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "　", "'s", "'LL", "1", "٣", ".", "!!", ",", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|>", "漢字", "。", "が", "が", "​", "😀", "\x00", "The", "don't", "한", "한"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += ["漢字が、これは。" * 3000, "aB3" * 4000, "x" * 20_000, "word " * 300_000, "a1b2 " * 200_000, ""]
    found = token_ids.WordIds(PATH).of([t.encode() for t in texts])
    for text, own, ids in zip(texts, found, token_ids.plain_ids(PATH, texts), strict=True):
        assert own.tolist() == ids, text[:50]


def test_the_table_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(token_ids, "MOST_WORDS", 200)
    table, texts = token_ids.WordIds(PATH), [" ".join(f"w{i + j}x" for j in range(60)) for i in range(0, 600, 30)]
    assert [table.of([t.encode()])[0].tolist() for t in texts] == token_ids.plain_ids(PATH, texts)
    assert len(table.young) <= 200 and len(table.old) <= 200


def test_words_and_their_punctuation_are_learned_apart_and_looked_up_once_a_slice():
    class Counted(dict):
        asked = 0

        def get(self, word):
            self.asked += 1
            return super().get(word)

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    table, text = token_ids.WordIds(PATH), "Word word. (word, été! word?! " * 1000
    table.young = Counted()
    assert table.of([text.encode()])[0].tolist() == token_ids.plain_ids(PATH, [text])[0]
    assert set(table.young) == {w.encode() for w in ("word", "été", ".", "(", ",", "!", "?!")}
    assert table.young.asked <= 2 * len(table.young)


def test_cuts_between_letters_and_punctuation_are_those_of_the_tokenizer():
    texts = ["a≠b", "a.≮", "x's.t'll.'s", "'.s'.RE.'re", "..'VE", "É.é!Ḿ", "÷.a×.b", "<|endoftext|>.a B.C a<|b c.d", "a.́b", "a`̀b", ";;.a", "K.K"]
    texts += ["\x1fa.b\x1f.c", "ÿ.Ā.ā", "İ.i", "a.ª.º.µ", "a.1.b2.-3", "日本.a。b", "ÀÉ.Ü-ß/ÿ", " ", "\n \t", "", "a", "Ã", ". a"]
    found = token_ids.WordIds(PATH).of([t.encode() for t in texts])
    assert [ids.tolist() for ids in found] == token_ids.plain_ids(PATH, texts)


def check(rows, docs):
    """Every id in one piece, sequences without gaps and of full or power-of-two length."""
    ids = [i + [2] for i in token_ids.plain_ids(PATH, [t or "" for _, t in docs])]
    wanted, found, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for (doc, _), own in zip(docs, ids, strict=True):
        wanted[doc].append(own)
    for r in rows:
        found[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(found) == set(wanted)
    for doc, own in wanted.items():
        covered = Counter()
        for r in found[doc]:
            fitting = [i for i in own if len(i) == r.doc_tokens and zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert fitting and r.length > 0 and r.start + r.length <= r.doc_tokens
            covered.update((r.doc_tokens, k) for k in range(r.start, r.start + r.length))
        assert covered == Counter((len(i), k) for i in own for k in range(len(i)))
    lengths = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    assert max(lengths) <= 4096 and all(n == 4096 or n & (n - 1) == 0 for n in lengths)


def test_supplied_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(OP13(spark, SF).collect(), docs)


def test_odd_documents(spark, odd_dir):
    check(OP13(spark, odd_dir).collect(), [(d[0], d[1]) for d in ODD])


def test_small_shards_and_ids(spark):
    """Left-overs move on from shard to shard, and the ids come along."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = packing.pack(docs, shard_tokens=20_000, with_ids=True).collect()
    check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def plain_scores(units, idf, average, seed):
    out = []
    for unit in units:
        times = Counter(unit.tolist())
        out.append(sum(idf[t] * times[t] * 2.2 / (times[t] + 1.2 * (0.25 + 0.75 * len(unit) / average)) for t in set(units[seed].tolist()) if t in times))
    return out


def test_windows_take_the_best_unused_units():
    rng = random.Random(4)
    units = [np.array(rng.choices(range(40 * (i % 3), 40 * (i % 3) + 60), k=rng.randint(1, 30))) for i in range(80)]
    df = Counter(t for u in units for t in set(u.tolist()))
    idf = np.array([math.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(200)])
    average = sum(map(len, units)) / 80
    index = packing.Postings(units, idf, average)
    for seed in range(80):
        assert np.allclose(index.scores(seed), plain_scores(units, idf, average, seed))
    *full, over = packing.windows(index, np.array([len(u) for u in units]), 64)
    assert all(sum(b - a for _, a, b in w) == 64 for w in full) and sum(b - a for _, a, b in over) < 64
    used = set()
    for w in full:
        seed, *taken = [u for u, _, _ in w]
        scores = plain_scores(units, idf, average, seed)
        rest = [u for u in range(80) if u not in used and u not in (seed, *taken)]
        used |= {u for u, _, _ in w}
        assert all(scores[t] >= max((scores[u] for u in rest), default=0) - 1e-9 for t in taken)
        assert [scores[t] for t in taken] == sorted((scores[t] for t in taken), reverse=True)
    assert sorted((u, k) for w in [*full, over] for u, a, b in w for k in range(a, b)) == [(u, k) for u in range(80) for k in range(len(units[u]))]


@pytest.mark.parametrize("total", [0, 1, 5, 64, 100])
def test_powers_of_two(total):
    lists = list(packing.powers_of_two([(0, 10, 10 + total // 3), (1, 0, total - total // 3)]))
    lengths = [sum(b - a for _, a, b in pieces) for pieces in lists]
    assert lengths == [1 << k for k in reversed(range(8)) if total >> k & 1]
