"""Texts in scripts without blanks: words, leaks, near copies."""

import random
import re

import numpy as np
import pytest
from fixtures import alnum

from tidewire.llm import bag_minhash, decontaminate, words

OWN = "฀-໿က-႟ក-៿⺀-⿿぀-䶿一-鿿豈-﫿０-９Ａ-Ｚ｀-﾿\U00020000-\U00033fff"
GAP = " -ⁿ　-〿＀-／：-＠［-＿\x00-/:-@\\[-`{-\x7f"
WORDS = re.compile(f"[{OWN}]|[^{OWN}{GAP}]+")
SCRIPTS = {
    "chinese": [chr(c) for c in range(0x4E00, 0x4E00 + 900)],
    "japanese": [chr(c) for c in range(0x3041, 0x3097)] + [chr(c) for c in range(0x5B50, 0x5B50 + 300)],
    "thai": [chr(c) for c in range(0x0E01, 0x0E2F)] + [chr(c) for c in range(0x0E40, 0x0E46)],
}


def prose(rng, script, n):
    letters = SCRIPTS[script]
    return "".join(rng.choice(letters) + ("。" if i % 31 == 30 else "") for i in range(n))


def plain(text):
    return WORDS.findall("".join(c.lower() if c < "\x80" else c for c in text))


def test_words_by_character_are_those_of_a_pattern():
    rng = random.Random(1)
    parts = ["abc", "Z9", " ", ".", "é", "ß", "漢", "字", "ひ", "ー", "。", "、", "！", "Ａ", "５", "「", "ไ", "ท", "ย", "한글", "“", "”", "—", "😀", "𠀀", "ב", "ລ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["x" * 3_000_001 + "漢" + "y" * 1_500_000, "漢" * 1_000_000, "é" * 1_200_000 + " " + "ย" * 700_000, "a" * (1 << 20) + "b", "字" + "q" * (2 << 20)]
    h, bounds = words.hashes([t.encode() for t in texts], words.ALNUM, by_character=True)
    own = [plain(t) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in own]
    flat = [w for some in own for w in some]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    latin = [t for t in texts if t.isascii()] + ["Größe, ñandú ÉTÉ"]
    for split in (False, True):
        h, bounds = words.hashes([t.encode() for t in latin], words.ALNUM, split)
        assert np.diff(bounds).tolist() == [len(alnum(t)) for t in latin]


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_leaks_in_scripts_without_blanks(spark, script):
    rng = random.Random(2)
    item, filler = prose(rng, script, 120), [prose(rng, script, 400) for _ in range(4)]
    cut = [item[i : i + 30] for i in range(0, len(item), 30)]
    texts = [filler[0] + item + filler[1], filler[2] + "".join(reversed(cut)) + filler[3], filler[0], item[:50] + filler[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminated(docs, items).select("doc_id").collect()} == {2, 3}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_near_copies_in_scripts_without_blanks(spark, script):
    rng = random.Random(3)
    text = prose(rng, script, 2000)
    near = text[:1000] + SCRIPTS[script][0] + text[1001:]
    docs = [(1, text), (2, near), (3, text), (4, prose(rng, script, 2000)), (5, prose(rng, script, 50))]
    kept = bag_minhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5]
