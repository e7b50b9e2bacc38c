"""Queries whose results SQL can't state, against plain Python."""

import math
import random
import zlib
from base64 import b64encode
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from fixtures import ODD, alnum, bag, blank, near_classes

from tidewire.llm import bag_minhash, compression_bands, decontaminate, kneser_ney, language_id, license_scan, ngram_trie, toxicity, words
from tidewire.llm import queries as llm
from tidewire.llm.elias_fano import EliasFano

QUERIES = llm.queries()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def texts(documents):
    return [(i, d.text) for i, d in sorted(documents.items())] + [(1_000_000 + n, d[1]) for n, d in enumerate(ODD[:-5]) if len(d[1] or "") < 10_000]


def encoded(rows):
    return [None if t is None else t.encode() for _, t in rows]


# --- words ----------------------------------------------------------------------------------


def test_word_hashes_split_as_patterns_do(documents):
    rows = texts(documents) + [(0, "z" * 3_000_000 + " y " * 900_000), (0, "é" * 2_000_000)]
    for table, split in ((words.ALNUM, alnum), (words.BLANK, blank)):
        h, bounds = words.hashes(encoded(rows), table)
        own = [split(t) for _, t in rows]
        assert np.diff(bounds).tolist() == [len(w) for w in own]
        flat = [w for some in own for w in some]
        assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


# --- op1 ------------------------------------------------------------------------------------


def test_license_places(documents):
    rng = random.Random(3)
    tokens = "gnu general public license apache cc by mit under the x of licensed".split()
    rows = texts(documents) + [(0, " ".join(rng.choices(tokens, k=rng.randint(1, 60)))) for _ in range(300)]
    out = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES).scan(encoded(rows))
    for n, (_, text) in enumerate(rows):
        own = alnum(text)
        places = [
            (i, label)
            for phrase, label in license_scan.PHRASES.items()
            for i in range(len(own))
            if own[i : i + len(phrase.split())] == phrase.encode().split()
        ]
        want = (
            len(own), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None),
            ",".join(sorted({label for _, label in places})),
        )
        assert tuple(c[n].as_py() for c in out[:5]) == want
        assert {label for _, label in places} <= set(out[5][n].as_py().split(",")) | {""}
        assert 0 <= out[6][n].as_py() <= 1


def test_license_templates_are_found_with_gaps():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    long = [(label, t) for label, t in license_scan.TEMPLATES if len(t.split()) > 20]
    changed = [t.replace("software", "program", 1) for _, t in long]
    out = scanner.scan([f"before {t} after".encode() for t in changed])
    assert all(label in found.as_py().split(",") for (label, _), found in zip(long, out[5], strict=True))
    half = [" ".join(t.split()[: len(t.split()) // 2]) for _, t in long]
    out = scanner.scan([t.encode() for t in half])
    assert not any(label in found.as_py().split(",") for (label, _), found in zip(long, out[5], strict=True))


def test_licenses_are_not_taken_for_their_siblings():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    gpl = next(t for label, t in license_scan.TEMPLATES if label == "gpl-notice")
    cases = [
        (gpl, ["gpl-notice"]),
        (gpl.replace("GNU General", "GNU Affero General"), ["agpl-notice"]),
        (gpl.replace("GNU General", "GNU Lesser General"), ["lgpl-notice"]),
        ("licensed under the GNU General Public License, version 2", ["gpl-2.0"]),
        (f"{gpl} x. Released under the MIT License", ["gpl-notice", "mit-notice"]),
        ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
         "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
         "commercial or non-commercial, and by any means.", ["unlicense"]),
    ]
    spans = scanner.scan([t.encode() for t, _ in cases])[7]
    assert [sorted({s["label"] for s in found.as_py()}) for found in spans] == [want for _, want in cases]


def test_automaton_knows_every_run():
    rng = random.Random(1)
    sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    automaton = license_scan.Automaton(sequences)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randrange(4) for _ in range(400)]
    state = run = 0
    for i, token in enumerate(text):
        state, run = automaton.step(state, run, token)
        want = max((n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in known), default=0)
        assert run == want


# --- op2 ------------------------------------------------------------------------------------


def plain_tiles(a, b, k):
    """Greedy string tiling by searching all places again and again."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n >= k and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        used_a.update(range(best[0], best[0] + best[2]))
        used_b.update(range(best[1], best[1] + best[2]))


def test_tiles_equal_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(2))
        seeds = [(i, j) for i in range(len(a) - 2) for j in range(len(b) - 2) if a[i : i + 3] == b[j : j + 3]]
        assert decontaminate.tiles(seeds, 3) == plain_tiles(a, b, 3)


def test_leaks_equal_plain_search(spark, documents):
    items = {r.item_id: alnum(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    seeds = defaultdict(set)
    for item, own in items.items():
        for j in range(len(own) - 4):
            seeds[tuple(own[j : j + 5])].add((item, j))
    want = set()
    for doc, row in documents.items():
        own = alnum(row.text)
        found = defaultdict(list)
        for i in range(len(own) - 4):
            for item, j in seeds.get(tuple(own[i : i + 5]), ()):
                found[item].append((i, j))
        for item, matches in found.items():
            covered = sum(t[2] for t in decontaminate.tiles(matches)) / len(items[item])
            if covered >= decontaminate.LEAST_COVERED:
                want.add((doc, item, covered))
    got = {(r.doc_id, r.item_id, r.covered) for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert got == want and want


def test_reordered_leaks(spark, odd_dir):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op2_decontaminate"](spark, odd_dir).collect()}
    assert got == {(6, 1), (6, 5), (7, 1), (7, 5)}


# --- op3, op4: held-out accuracy ------------------------------------------------------------


def test_languages_of_held_out_documents(spark, documents):
    rows = QUERIES["op3_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in held) / len(held) > 0.97


def test_rare_languages_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 100)
    monkeypatch.setattr(language_id, "MOST_SAMPLE", 500)
    sizes = {f"l{i:02}": 2000 if i < 44 else 8 for i in range(50)}
    rows = [(doc, lang) for doc, lang in enumerate(lang for lang, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame([(doc, f"text {doc}", lang) for doc, lang in rows], "doc_id long, text string, lang string")
    found = Counter(r.lang for r in language_id.sample(docs).collect())
    left = Counter(lang for doc, lang in rows if zlib.crc32(str(doc).encode()) % 4 != 2)
    assert set(found) == set(sizes) and sum(found.values()) <= 500
    assert all(found[lang] == left[lang] for lang, n in sizes.items() if n == 8)


def test_texts_without_letters_have_no_language(spark, odd_dir):
    rows = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, odd_dir).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and rows[1].score == 0


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_toxicity"](spark, sf).collect() if r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    bad = [r for r in held if toxic[r.doc_id]]
    assert sum(r.predicted for r in bad) / len(bad) > 0.8
    assert sum(r.predicted for r in held if not toxic[r.doc_id]) <= 0.01 * len(held)


def test_folding_and_exceptions():
    lexicon, exceptions = (("clown", 2.0), ("idiot", 3.0)), ("clown fish",)
    for text, weight in (
        ("You 1D10T!", 3.0), ("an іdіot", 3.0), ("idi\u200bots", 3.0), ("a Clown-fish", 0.0), ("clown. fishing clown", 2.0),
        ("clown fish and clown", 2.0), ("", 0.0), ("nonidiot", 0.0), ("ｉｄｉｏｔ", 3.0),
    ):
        assert toxicity.weight_found(toxicity.folded(text), lexicon, exceptions)[0] == weight


# --- op5 ------------------------------------------------------------------------------------


def test_quality_counts(documents):
    rows = texts(documents)
    out = compression_bands.judge(encoded(rows))
    for n, (_, text) in enumerate(rows):
        own = blank(text)
        runs = defaultdict(list)
        for i in range(len(own) - 7):
            runs[tuple(own[i : i + 8])].append(i)
        repeated = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [line for line in (text or "").split("\n") if blank(line)]
        want = (
            len(own), sum(len(w.decode()) for w in own), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(repeated), len(own) < 20 or 100 * len(repeated) > 30 * len(own),
        )
        assert tuple(c[n].as_py() for c in out[:6]) == want
        assert not (want[-1] and out[6][n].as_py())


def test_bands_reject_repetition_and_noise():
    rng = random.Random(2)
    loop = "".join(f"line {i % 7} says it all over again\n" for i in range(3000))
    unpacked = compression_bands.shares(loop.encode(), compression_bands.zstandard.ZstdCompressor(level=3))
    assert unpacked[0] < compression_bands.band(len(loop))[0]
    prose = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(300))
    out = compression_bands.judge([loop.encode(), rng.randbytes(20_000), prose.encode()])
    assert [kept.as_py() for kept in out[6]] == [False, False, True]


def test_bands_reject_noise_in_valid_text():
    rng = random.Random(8)
    printable = [chr(c) for c in range(33, 127)]
    for n in (170, 250, 400, 499, 700, 999, 1500, 2999, 4096, 20_000, 200_000):
        base64 = b64encode(rng.randbytes(n)).decode()
        for noise in (base64, "".join(rng.choices(printable, k=n))):
            dump = " ".join(noise[i : i + 7] for i in range(0, n, 7))[:n].encode()
            out = compression_bands.judge([dump])
            assert not out[5][0].as_py() and not out[6][0].as_py(), (n, out[7][0].as_py())
    # Chunks of noise between lines of prose.
    prose = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(3000))[:8192]
    mixed = prose.encode() + b64encode(rng.randbytes(9216))
    assert compression_bands.shares(mixed, compression_bands.zstandard.ZstdCompressor(level=3))[1] == 0.6


# --- op7 ------------------------------------------------------------------------------------


def test_elias_fano_round_trip():
    rng = np.random.default_rng(4)
    for n, universe in ((0, 1), (1, 1), (5, 5), (1000, 1 << 50), (3000, 4000), (2000, 1 << 63)):
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        sequence = EliasFano(*EliasFano.parts(values, universe))
        assert (sequence.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64)])
        at = sequence.find(asked)
        known = np.isin(asked, values)
        assert ((at >= 0) == known).all() and (values[at[known]] == asked[known]).all()


def test_scores_equal_plain_counts(spark, documents):
    rows = ngram_trie.scored(spark.read.parquet(f"{SF}/documents.parquet"), chunk_bytes=1 << 30).collect()
    tokens = {i: [w.lower() for w in blank(d.text)] + [None] for i, d in documents.items()}
    training = [i for i in tokens if zlib.crc32(str(i).encode()) % 10 != 0]
    one, two = Counter(), Counter()
    for i in training:
        one.update(tokens[i])
        two.update(zip([0, *tokens[i]], tokens[i], strict=False))
    begun = Counter(one) + Counter({0: len(training)})
    followers = Counter(v for v, _ in two)
    n, v = sum(one.values()), len(one)
    # One chunk has one shard, whose discount is that of all pairs. The rest is the 8-bit codes.
    d = sum(c == 1 for c in two.values()) / (sum(c == 1 for c in two.values()) + 2 * sum(c == 2 for c in two.values()))
    total = plain_total = 0.0
    assert len(rows) == len(documents)
    for r in rows:
        own = tokens[r.doc_id]
        alone = [(one[w] + 0.1) / (n + 0.1 * (v + 1)) for w in own]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(one[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, alone)), rel=1e-9)
        plain = 0.0
        for before, w, p in zip([0, *own], own, alone, strict=False):
            c = begun[before]
            plain += math.log10((max(two[before, w] - d, 0) + d * followers[before] * p) / c if c else p)
        assert r.score == pytest.approx(plain, rel=0.005, abs=0.01 * len(own))
        total, plain_total = total + r.score, plain_total + plain
    assert total == pytest.approx(plain_total, rel=0.002)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_number_of_chunks_changes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = ({r.doc_id: r for r in ngram_trie.scored(docs, chunk_bytes=size).collect()} for size in (1 << 30, 50_000))
    for i, r in few.items():
        assert r.base_score == pytest.approx(many[i].base_score, rel=1e-12)
    # Shards have discounts of their own; with shards this small they differ somewhat.
    assert sum(r.score for r in few.values()) == pytest.approx(sum(r.score for r in many.values()), rel=0.02)


def packed(number, rows):
    """What a chunk sends to one shard, from rows (word, count, {successor: count})."""
    rows = sorted(rows)
    pairs = [sorted(r[2].items()) for r in rows]
    columns = {
        "hashes": np.array([r[0] for r in rows], np.uint64), "ones": np.array([r[1] for r in rows], ngram_trie.COUNT),
        "lengths": np.array([len(p) for p in pairs], np.uint32),
        "successors": ngram_trie._narrow(np.array([w for p in pairs for w, _ in p], np.uint64)),
        "twos": np.array([c for p in pairs for _, c in p], ngram_trie.COUNT),
    }
    row = {name: pa.array([ngram_trie._zip(x)], pa.binary()) for name, x in columns.items()}
    return pa.table({"shard": pa.array([0], pa.int32()), "chunk": pa.array([number], pa.int32()), **row})


def score_of_rare(begun):
    """The row of the text "rare", and its plain base score and score, if ``begun`` texts begin, and a quarter ends at once."""
    rare, end, start = int(words.hashes([b"rare"], words.BLANK_LOWER)[0][0]), ngram_trie.END, ngram_trie.START
    asked = pa.concat_tables([
        packed(0, [(start, 1, {rare: 1}), (rare, 1, {end: 1}), (end, 1, {})]),
        packed(1, [(start, begun - 1, {end: begun // 4}), (end, begun // 4, {})]),
    ])
    replies = ngram_trie.answers(asked)
    docs = pa.table({"text": pa.array([b"rare"]), "doc_id": pa.array([1]), "held_out": pa.array([False])})
    row = ngram_trie.scores(docs, replies.filter(pa.compute.equal(replies["chunk"], 0))).to_pylist()[0]
    tokens = begun // 4 + 2
    alone = [1.1 / (tokens + 0.3), (begun // 4 + 1.1) / (tokens + 0.3)]
    d = ngram_trie.DEFAULT_DISCOUNT
    plain = math.log10((1 - d + 2 * d * alone[0]) / begun) + math.log10(1 - d + d * alone[1])
    return row, sum(map(math.log10, alone)), plain


def test_rare_pairs_of_a_very_frequent_word():
    row, _, plain = score_of_rare(3_000_000_000)
    assert row["score"] == pytest.approx(plain, rel=1e-6)


def test_counts_beyond_32_bits():
    row, base, plain = score_of_rare(60_000_000_000)
    assert row["base_score"] == pytest.approx(base, rel=1e-12)
    assert row["score"] == pytest.approx(plain, rel=1e-6)


def test_discount_is_that_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = ({r.doc_id: r for r in ngram_trie.scored(docs, chunk_bytes=size).collect()} for size in (1 << 30, 50_000))
    # Only the spacing of codes for counts over EXACT differs.
    for i, r in few.items():
        assert r.score == pytest.approx(many[i].score, abs=0.002 * r.n_tokens)


def test_pairs_of_a_frequent_word_go_to_many_shards():
    rng = random.Random(3)
    text = [" ".join(x for i in range(300) for x in ("the", f"w{rng.randrange(5000)}")).encode() for _ in range(30)]
    table = pa.table({
        "text": pa.array(text), "training": pa.array([i % 10 > 0 for i in range(30)]), "chunk": pa.array([i % 2 for i in range(30)], pa.int32()),
        "doc_id": pa.array(range(30)), "held_out": pa.array([i % 10 == 0 for i in range(30)]),
    })
    the = int(words.hashes([b"the"], words.BLANK_LOWER)[0][0])
    out, largest = [], []
    for frequent in (ngram_trie.NONE, ngram_trie.Frequent([the, ngram_trie.START], [32, 3])):
        chunks = [table.filter(pa.compute.equal(table["chunk"], i)) for i in range(2)]
        asked = pa.concat_tables([ngram_trie.questions(c, 8, frequent) for c in chunks])
        by_shard = [asked.filter(pa.compute.equal(asked["shard"], i)) for i in range(8)]
        pairs = [sum(len(ngram_trie._unzip(x, np.uint8)) // 5 for x in t["successors"].to_pylist()) for t in by_shard]
        largest.append(max(pairs) / sum(pairs))
        replies = pa.concat_tables([ngram_trie.answers(t, frequent) for t in by_shard])
        out.append([ngram_trie.scores(c, replies.filter(pa.compute.equal(replies["chunk"], i)), frequent).to_pylist() for i, c in enumerate(chunks)])
    assert largest[0] > 0.5 and largest[1] < 0.3
    for a, b in zip(sum(out[0], []), sum(out[1], []), strict=True):
        assert {k: v for k, v in a.items() if k != "score"} == {k: v for k, v in b.items() if k != "score"}
        assert b["score"] == pytest.approx(a["score"], rel=0.01)


def test_frequent_words_are_found(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', 'The', id, 'the', id + 1000, 'the', id + 2000) AS text")
    found = ngram_trie.frequent_words(docs.selectExpr("CAST(text AS BINARY) AS text"), 10_000, 20)
    the = int(words.hashes([b"the"], words.BLANK_LOWER)[0][0])
    assert dict(zip(found.hashes.tolist(), found.places.tolist(), strict=True)) == {the: 9, ngram_trie.START: 3}


def test_codes_follow_the_largest_count():
    for most in (1, 64, 65, 10**6, 10**13):
        counts = np.unique(np.geomspace(1, most, 5000).astype(np.int64))
        back = ngram_trie.decoded(ngram_trie.codes(counts, most), most)
        assert (back[counts <= ngram_trie.EXACT] == counts[counts <= ngram_trie.EXACT]).all()
        assert np.abs(back / counts - 1).max() < 0.08


# --- op8 ------------------------------------------------------------------------------------


class PlainModel:
    """Interpolated modified Kneser-Ney, word by word."""

    def __init__(self, sequences, order):
        counts = {order: Counter()}
        for s in sequences:
            counts[order].update(tuple(s[j - order + 1 : j + 1]) for j in range(order - 1, len(s)))
        for k in range(order - 1, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.counts, self.taken, self.total, self.left = counts, {}, defaultdict(int), defaultdict(float)
        self.words = len(counts[1])
        for k in range(1, order + 1):
            spread = Counter(counts[k].values())
            self.taken[k] = kneser_ney.discounts(*(spread[i] for i in range(1, 5)))
            for g, c in counts[k].items():
                self.total[g[:-1]] += c
                self.left[g[:-1]] += self.taken[k][min(c, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / (self.words + 1)
        lower, context = self.p(g[1:]), g[:-1]
        if context not in self.total:
            return lower
        c = self.counts[len(g)][g]
        own = c - self.taken[len(g)][min(c, 3) - 1] if c else 0
        return own / self.total[context] + self.left[context] / self.total[context] * lower


def test_ngram_names_are_those_of_spark(spark):
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    rows = [tuple(tokens[i : i + 3].view(np.int64).tolist()) for i in range(48)]
    df = spark.createDataFrame(rows, "a long, b long, c long").selectExpr("xxhash64(a)", "xxhash64(a, b)", "xxhash64(a, b, c)")
    found = kneser_ney.names(tokens, 3)
    assert [tuple(r) for r in df.collect()] == [tuple(int(n[i].view(np.int64)) for n in found) for i in range(48)]


@pytest.mark.parametrize(("order", "chunk"), [(2, 1 << 21), (3, 3000)])
def test_perplexities_equal_plain_model(spark, documents, monkeypatch, order, chunk):
    monkeypatch.setattr(kneser_ney, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(kneser_ney, "PART_BYTES", chunk)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.trusted for r in kneser_ney.trusted_ids(labels).collect()}
    rows = {r.doc_id: r for r in kneser_ney.classified(docs, labels, order=order).collect()}
    assert rows.keys() == documents.keys()

    def sequence(text):
        return ["<s>"] * (order - 1) + alnum(text) + ["</s>"]

    learned = [i for i in sorted(good & documents.keys()) if rows[i].learned and alnum(documents[i].text)]
    assert 0.3 * len(good) < len(learned) < 0.7 * len(good)
    model = PlainModel([sequence(documents[i].text) for i in learned], order)
    context = ("<s>",) * (order - 1)
    assert sum(model.p((*context, w)) for w in [*(w for (w,) in model.counts[1]), "never met"]) == pytest.approx(1, rel=1e-9)
    for i in sorted(documents)[::5]:
        s = sequence(documents[i].text)
        assert rows[i].n_words == len(s) - order
        if len(s) > order:
            want = 10 ** (-sum(math.log10(model.p(tuple(s[j - order + 1 : j + 1]))) for j in range(order - 1, len(s))) / (len(s) - order + 1))
            assert rows[i].perplexity == pytest.approx(want, rel=1e-6)
    assert sum(rows[i].kept for i in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in rows.values()) > 20


def test_words_in_another_order_are_less_likely(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(6)
    mixed = []
    for i in sorted({r.trusted for r in kneser_ney.trusted_ids(labels).collect()} & documents.keys()):
        own = (documents[i].text or "").split()
        rng.shuffle(own)
        if len(own) >= 40:
            mixed.append((10_000_000 + i, " ".join(own), documents[i].lang))
    both = docs.unionByName(spark.createDataFrame(mixed, docs.schema))
    rows = {r.doc_id: r for r in kneser_ney.classified(both, labels).collect()}
    # Of texts not learned from, and of those learned from.
    for learned, least in ((False, 1.15), (True, 8)):
        ratios = [rows[i].perplexity / rows[i - 10_000_000].perplexity for i, *_ in mixed if rows[i - 10_000_000].learned == learned]
        assert len(ratios) > 100 and np.median(ratios) > least and np.mean(np.array(ratios) > 1) > 0.8


# --- op10 -----------------------------------------------------------------------------------


def test_registers_are_unbiased():
    rng = random.Random(1)
    errors = []
    for trial in range(150):
        n = rng.choice([3, 20, 200])
        a = {i: rng.choice([1, 1, 2, 5, 30]) for i in range(n)}
        b = {i: (w if rng.random() < 0.7 else rng.choice([1, 3, 40])) for i, w in a.items()} | {n + i: 2 for i in range(n // 5)}
        want = sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values())
        names = words.mixed(np.arange(1000, dtype=np.uint64) + np.uint64(trial * 100_000))
        r = bag_minhash.registers(
            np.concatenate([names[list(a)], names[list(b)]]), np.array([*a.values(), *b.values()]),
            np.array([0] * len(a) + [1] * len(b)), 2,
        )
        errors.append((r[0] == r[1]).mean() - want)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_packed_bags_overlap_exactly():
    rng = random.Random(7)
    for _ in range(50):
        some = [" ".join(rng.choices("a b c d".split(), k=rng.randint(1, 60))) for _ in range(2)]
        packed = []
        for text in some:
            shingle, weight, _ = bag_minhash.bags([text.encode()])
            packed.append(bag_minhash.packed_bag(shingle, weight))
        x, y = map(bag, some)
        assert bag_minhash.overlap(*packed) == pytest.approx(sum((x & y).values()) / sum((x | y).values()))


def test_classes_equal_all_pairs(spark, documents):
    want = near_classes([(i, d.text) for i, d in documents.items()])
    got = {r.doc_id: r.class_id for r in QUERIES["op10_bag_minhash"](spark, SF).collect()}
    assert got == want


def test_large_groups_equal_all_pairs(spark):
    """Two families that overlap in part, with far more members than a small group has."""
    rng = random.Random(11)
    base = [[f"{name}{i}" for i in range(120)] for name in "pq"]
    rows = []
    for n in range(150):
        own = list(base[n % 2])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10_000)}"
        rows.append((n, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(docs).collect()}
    assert got == near_classes(rows)


def test_odd_classes(spark, odd_dir):
    got = {r.doc_id: r.class_id for r in QUERIES["op10_bag_minhash"](spark, odd_dir).collect() if r.doc_id is not None}
    assert got[2] == 1 and got[3] == 3 and got[4] == 4 and got[11] == 10 and got[14] == got[15] == 14 and got[16] == 16
