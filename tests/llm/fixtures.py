"""Small tables with every odd case, and brute-force helpers."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def alnum(text: str | None) -> list[bytes]:
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return ALNUM.findall(lowered)


def blank(text: str | None) -> list[bytes]:
    return BLANK.findall((text or "").encode())


LEAK = "one two three four five six seven eight nine ten eleven twelve"

#: (doc_id, text, lang, source, n_chars): nulls, empties, ties, repeated rows, odd characters, a very long text.
ODD = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 4),
    (4, "word", "en", "b", 4),
    (4, "word", "en", "b", 4),
    (None, "word", None, None, 4),
    (None, None, None, None, None),
    (None, None, None, None, None),
    (5, "The MIT License, the mit license; cc by cc by", "en", "c", 45),
    (6, f"x y z {LEAK} and more", "en", "a", 80),
    (7, f"{LEAK[28:]} then {LEAK[:27]}", "en", "a", 60),
    (8, "größe ÄÖÜ ñandú 漢字 \u0000 \U0001f600 idiot", "de", "aé", 30),
    (9, "### $$$ 123 %%%", "fr", "z", 14),
    (10, "a b c d e f g h " * 20_000, "en", "b", 320_000),
    (11, "a b c d e f g h " * 20_000, "en", "b", 320_000),
    (-12, "x" * 1_500_000, "en", "b", 1_500_000),
    (13, "You are a stupid idiot and a moron, you worthless clown", "en", "b", 50),
    (14, " ".join(f"w{i}" for i in range(40)), "es", "c", 150),
    (15, " ".join(f"w{i}" for i in range(1, 41)), "es", "c", 150),
    (16, " ".join(f"v{i}" for i in range(40)) + " 1", "es", "c", 150),
]

CLASHING = ["score", "size", "shard", "kept", "n_words", "copies", "row", "node", "taken", "target", "chunk", "covered", "labels"]
CLASHING_OTHERS = ["n", "component", "deviation", "code", "conv", "copies", "cost", "audit", "segment", "blank"]

LABELS = [(1, 1, 0), (4, 1, 0), (4, None, 1), (13, 0, 1), (None, 1, 1), (14, 1, None), (99, 0, 0), (5, 1, 0)]
BENCHMARK = [(1, LEAK), (2, None), (3, ""), (4, "too short"), (5, LEAK.upper().replace(" ", ", ")), (None, "p q r s t u v")]
EMBEDDINGS = [
    (1, [0.5, -0.25, 1.0]), (2, None), (3, [0.1, None, 0.2]), (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]),
    (6, []), (7, [1.0]), (8, [0.5, -0.25, 1.0]), (8, [0.5, -0.25, 1.0]), (None, [-0.0, 1e30, -1e30]), (9, [0.0, 0.0, 0.0]),
    (10, [0.3, 0.2, 0.1]), (11, [0.3001, 0.2, 0.1]),
]
CONVERSATIONS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (2, 0, None, None), (None, None, None, None),
    (None, 1, "user", "x"), (3, 1, "user", "z" * 100_000), (3, 1, "user", "z" * 100_000), (4, 2**62, "tool", "a."), (4, 0, "", ""),
]


def write_tables(folder: Path, documents: list[tuple], clashing: bool) -> str:
    columns = list(zip(*documents, strict=True)) if documents else [[]] * 5
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    docs = {name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)}
    if clashing:
        docs |= {name: pa.array([f"old {i}" for i in range(len(documents))], pa.string()) for name in CLASHING}
    labels = list(zip(*LABELS, strict=True)) if documents else [[]] * 3
    items = list(zip(*BENCHMARK, strict=True)) if documents else [[]] * 2
    vectors = list(zip(*EMBEDDINGS, strict=True)) if documents else [[]] * 2
    turns = list(zip(*CONVERSATIONS, strict=True)) if documents else [[]] * 4
    others = {
        "embeddings": {"vec_id": pa.array(vectors[0], pa.int64()), "embedding": pa.array(vectors[1], pa.list_(pa.float32()))},
        "conversations": {
            "conv_id": pa.array(turns[0], pa.int64()), "turn": pa.array(turns[1], pa.int64()),
            "role": pa.array(turns[2], pa.string()), "text": pa.array(turns[3], pa.string()),
        },
    }
    if clashing:
        for other in others.values():
            rows = len(next(iter(other.values())))
            other |= {name: pa.array([f"old {i}" for i in range(rows)], pa.string()) for name in CLASHING_OTHERS}
    tables = others | {
        "documents": docs,
        "labels": {
            "doc_id": pa.array(labels[0], pa.int64()), "quality": pa.array(labels[1], pa.int32()),
            "toxic": pa.array(labels[2], pa.int32()),
        },
        "benchmark": {"item_id": pa.array(items[0], pa.int64()), "text": pa.array(items[1], pa.string())},
    }
    for name, table in tables.items():
        pq.write_table(pa.table(table), folder / f"{name}.parquet")
    return str(folder)


def bag(text: str | None, k: int = 5) -> Counter:
    own = alnum(text)
    k = min(k, len(own))
    return Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1)) if own else Counter()


def near_classes(rows: list[tuple[int, str | None]], similar: float = 0.8) -> dict[int, int]:
    """The least id of each document's class, by comparing all pairs."""
    bags = [(i, t or "", bag(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, text, own) in enumerate(bags):
        size = sum(own.values())
        for j, other_text, other in bags[:n]:
            total = sum(other.values())
            if text != other_text:
                if min(size, total) < similar * max(size, total) or not own or own.keys().isdisjoint(other):
                    continue
                common = sum((own & other).values())
                if common < similar * (size + total - common):
                    continue
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return {i: top(i) for i, _ in rows}
