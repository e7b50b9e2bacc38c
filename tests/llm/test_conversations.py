"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewire.llm import conversations
from tidewire.llm import queries as llm

OP12 = llm.queries()["op12_conversation_repair"]
SF = "/root/testdata/sf0.01"
ROLES = {"u": "user", "a": "assistant"}


def damaged(rows):
    """(conv, turn, role, text) after damage."""
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub(r"[.!?]", "", text) if fault == 2 else text)
        yield from [row] * {0: 0, 3: 2}.get(fault, 1)


def allowed(state, initial):
    """The state after a row, or None: before anything, after s, after u, after a."""
    return {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(initial)


def best_repair(symbols):
    """(cost, audit) of rows (initial, truncated, goes): the least over all paths, kept for each state."""
    now = {0: (0, "")}

    def with_inserts(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                to = allowed(state, "u") or allowed(state, "a")
                now[to] = min(now.get(to, (99999, "")), (cost + 2, audit + "I"))
        return now

    for initial, truncated, goes in symbols:
        found = {}
        for state, (cost, audit) in with_inserts(now).items():
            moves = [(3, "D", state)]
            if not goes:
                moves += [(truncated, "K", allowed(state, initial)), (2 + truncated, "R", allowed(state, "u") or allowed(state, "a"))]
            for more, letter, to in moves:
                if to is not None:
                    found[to] = min(found.get(to, (99999, "")), (cost + more, audit + letter))
        now = found
    now = with_inserts(now)
    return min(now[s] for s in (0, 3) if s in now)


def expected(rows):
    """Contract columns by conversation, one at a time."""
    out = {conv: None for conv, *_ in rows}
    after = sorted(damaged(rows), key=lambda r: (r[1] is not None, r[1] or 0))
    for conv in out:
        own = [r[1:] for r in after if r[0] == conv]
        turns = [t for t, _, _ in own if t is not None]
        symbols, faults, seen = [], {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            symbols.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit = best_repair(symbols)
        lines, state, at = [], 0, 0
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role = "user" if allowed(state, "u") else "assistant"
            if letter == "I":
                lines.append(f"{role}:")
                state = allowed(state, role[0])
                continue
            lines.append(f"{own[at][1] if letter == 'K' else role}:{own[at][2]}")
            state = allowed(state, own[at][1][:1] if letter == "K" else role[0])
            at += 1
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, digest)
    return out


def results(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def written(folder, rows):
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "cost": pa.string()}
    columns.append(["other"] * len(rows))
    table = {n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)}
    pq.write_table(pa.table(table), folder / "conversations.parquet")
    return str(folder)


def summaries(spark, folder, most):
    found = conversations.summaries(conversations.damage(spark.read.parquet(f"{folder}/conversations.parquet")), most)
    return results(found.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha256"))


def made_up(seed, conversations_=400, most=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "u", "Assistant"]
    texts = ["One. Two.", "what?", "no end", "", None, " \t\n", "ja!\n ", "same.", "x", "é "]
    rows = []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(roles[:2]) if rng.random() < 0.7 else rng.choice(roles)
            text = f"{rng.choice(texts[:3])} {turn}" + rng.choice([".", "?", ""]) if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]), role, text))
    # one row for each turn: the order of different rows of one turn is this operator's own
    return list({(r[0], r[1]): r for r in rows}.values())


def test_tables_equal_plain_search():
    rng = random.Random(5)
    for _ in range(3000):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randint(0, 13)))
        plain = [("sua?"[y // 2] if y < 8 else "u", y % 2 == 1 and y < 8, y == 8) for y in symbols]
        behind = conversations.vectors_behind(conversations.blocks_of(symbols))
        audit, cost, state = "", 0, 0
        for letters, _, _, state, spent in conversations.choices(symbols, behind):
            audit, cost = audit + letters, cost + spent
        audit += conversations.tables().at_end[state][0]
        assert (cost + 2 * len(conversations.tables().at_end[state][0]), audit) == best_repair(plain)


def test_supplied_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(OP12(spark, SF)) == expected(rows)


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 5])
def test_odd_conversations(spark, tmp_path, segment):
    """Nulls, blanks, foreign roles; short segments chain every conversation of more than five rows."""
    rows = made_up(1) + [(None, None, None, None), (None, 3, "user", "Hi."), (9000, None, "user", "a."), (9001, 2**40, "user", "b.")]
    folder, want = written(tmp_path, rows), expected(rows)
    assert results(OP12(spark, folder)) == want
    assert summaries(spark, folder, segment) == want


def test_ties_and_repeated_rows(spark, tmp_path):
    rows = made_up(2, 60) * 3
    assert results(OP12(spark, written(tmp_path, rows))) == expected(rows)


def test_one_long_conversation(spark, tmp_path):
    """Segments of several tasks give what one pass gives, and its rows come out in order."""
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", f"say {t}", f"fine {t}."])) for t in range(3000)]
    folder = written(tmp_path, rows)
    want = expected(rows)
    assert summaries(spark, folder, 64) == results(OP12(spark, folder)) == want
    left = conversations.repaired(conversations.damage(spark.read.parquet(f"{folder}/conversations.parquet")), 64)
    lines = [f"{r.role}:{r.text}" for r in left.orderBy("place").collect()]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[7][-1]


def test_repeated_row_beyond_a_segment(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 10_000), (1, 1, "assistant", "Ho.", 1)], "conv int, turn int, role string, text string, copies int")
    found = conversations.summaries(rows).collect()[0]
    assert (found.audit, found.cost, found.duplicate, found.illegal) == ("K" + "D" * 9999 + "K", 3 * 9999, 9999, 9999)


def test_empty_table(spark, tmp_path):
    df = OP12(spark, written(tmp_path, []))
    assert df.count() == 0 and df.dtypes == OP12(spark, SF).dtypes
