"""The learned operators' matching, kernels and fits against plain versions."""

import random
from base64 import b64encode

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tidewire.llm import compression_bands, language_id, toxicity


def plain_grams(piece):
    """The set of slots of a piece's n-grams."""
    data = [b + 32 if 65 <= b <= 90 else (32 if b in b"\t\n\v\f\r " else b) for b in piece]
    found = set()
    for i in range(len(data)):
        value = 0
        for n in range(1, min(4, len(data) - i) + 1):
            value = (value * 257 + data[i + n - 1] + 1) % 2**32
            found.add((n - 1) * language_id.SLOTS + ((value * 2654435761 % 2**32) >> 21))
    return found


def plain_kernel(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0


def some_texts(rng, n):
    letters = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "éàüöabcd "}
    out = [(lang, "".join(rng.choices(chars, k=rng.randint(1, 900)))) for lang, chars in letters.items() for _ in range(n)]
    rng.shuffle(out)
    return [t.encode() for _, t in out], [lang for lang, _ in out]


def test_kernels_equal_sets():
    some, _ = some_texts(random.Random(1), 6)
    rows = language_id.presence([*some, b"", b"x"])
    sets = [plain_grams(t) for t in [*some, b"", b"x"]]
    want = [[plain_kernel(a, b) for b in sets] for a in sets]
    assert np.allclose(rows @ rows.T, want, atol=1e-5)


def test_scores_equal_plain_ridge():
    rng = random.Random(2)
    some, langs = some_texts(rng, 70)  # 210 texts of one piece: 160 of them are landmarks
    names = sorted(set(langs))
    grams = [plain_grams(t) for t in some]
    by_lang = {name: [i for i, lang in enumerate(langs) if lang == name] for name in names}
    turns = [by_lang[name][turn] for turn in range(70) for name in names]
    landmarks = [grams[i] for i in turns[: language_id.LANDMARKS]]
    inner = np.array([[plain_kernel(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(inner)
    big = values > 1e-6 * values.max()
    root = vectors[:, big] / np.sqrt(values[big])

    def mapped(own):
        return np.hstack([np.array([[plain_kernel(a, b) for b in landmarks] for a in own]) @ root, np.ones((len(own), 1))])

    x = mapped(grams)
    weight = np.sqrt(1 / (len(names) * 70))
    pull = np.sqrt(language_id.RIDGE / len(names) / len(some) ** 0.5) * np.eye(x.shape[1])
    fresh, _ = some_texts(rng, 10)
    got = language_id.fit(some, langs).scores(fresh)
    for k, name in enumerate(names):
        goal = np.array([1.0 if lang == name else -1.0 for lang in langs])
        solved = np.linalg.lstsq(np.vstack([x * weight, pull]), np.concatenate([goal * weight, np.zeros(x.shape[1])]), rcond=None)[0]
        assert np.allclose(mapped([plain_grams(t) for t in fresh]) @ solved, got[:, k], atol=2e-3)


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, "short words here", "aa") for i in range(40)] + [(i, "è lungo " * 9000, "bb") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.sample(docs).groupBy("lang").agg(F.max(F.length("text")).alias("n")).collect()
    assert {r.lang: r.n for r in found} == {"aa": 16, "bb": language_id.MOST_PIECES * language_id.PIECE}


def plain_weight(text, lexicon, exceptions):
    safe = [(i, i + len(p)) for p in exceptions for i in range(len(text)) if text.startswith(" " + p, i)]
    total = 0.0
    for i, letter in enumerate(text):
        found = [w for entry, w in lexicon if letter == " " and text.startswith(" " + entry, i)]
        if found and not any(a <= i <= b for a, b in safe):
            total += max(found)
    return total, len(text.split())


def test_matches_equal_plain_search():
    rng = random.Random(3)
    parts = ["ab", "abc", "ba", "b", "c", " ", " ", "4b", "аb", "-", "​", "ab c", "ca"]
    for _ in range(400):
        entries = {"".join(rng.choices("abc", k=rng.randint(1, 4))): float(rng.randint(1, 9)) for _ in range(6)}
        exceptions = tuple({" ".join("".join(rng.choices("abc", k=2)) for _ in range(rng.randint(2, 3))) for _ in range(3)})
        text = toxicity.folded("".join(rng.choices(parts, k=rng.randint(0, 60))))
        lexicon = tuple(entries.items())
        assert toxicity.weight_found(text, lexicon, exceptions) == plain_weight(text, lexicon, exceptions)


def test_curve_is_the_best_one():
    rng = np.random.default_rng(4)
    rows = np.hstack([np.ones((500, 1)), rng.exponential(1, (500, 2))])
    labels = (rng.random(500) < 1 / (1 + np.exp(2 - rows[:, 1] - rows[:, 2]))).astype(float)

    def loss(curve):
        z = rows @ curve
        return np.sum(np.logaddexp(0, z) - labels * z) + 0.5 * np.array([1e-3, 1e-1, 1e-1]) @ curve**2

    best = np.array(toxicity.fitted_curve(rows, labels))
    for _ in range(200):
        assert loss(best) <= loss(best + rng.normal(0, 0.05, 3)) + 1e-9


def test_sample_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 3)
    monkeypatch.setattr(toxicity, "MOST_CLEAN", 4)
    docs = spark.createDataFrame([(i // 2, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    drawn = [sorted(toxicity.sample(docs.repartition(n), labels.repartition(n)).collect()) for n in (1, 5)]
    assert drawn[0] == drawn[1] and 0 < len(drawn[0]) <= 14


def test_last_chunk_is_judged():
    rng = random.Random(5)
    prose = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(3000)).encode()
    packer = zstandard.ZstdCompressor(level=3)

    def bad(text):
        return compression_bands.shares(text, packer)[1]

    noise = b64encode(rng.randbytes(9000))
    assert bad(prose[:4095]) == bad(prose[:4096]) == bad(prose[:5000]) == bad(prose[:12_288]) == 0.0
    assert bad(prose[:12_288] + noise[:4000]) == 0.25 and bad(prose[:4096] + noise[:4000]) == 0.5
    assert bad(noise[:4096]) == 1.0 and bad(prose[:4096] + noise[:8000]) == 2 / 3
