"""Pareto order sampling against plain inclusion probabilities."""

import random
from collections import Counter, defaultdict

import pytest

from tidewire.llm.mixing import mix, mixture

SCHEMA = "doc_id bigint, source string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_odds(sizes, rest):
    """Inclusion probabilities in proportion to size, those at 1 or above certain, found by trying again."""
    certain = set()
    while True:
        left = rest - sum(sizes[i] for i in certain)
        c = left / sum(s * s for i, s in enumerate(sizes) if i not in certain)
        more = {i for i, s in enumerate(sizes) if i not in certain and c * s >= 1}
        if not more:
            return [1.0 if i in certain else c * s for i, s in enumerate(sizes)]
        certain |= more


@pytest.fixture(scope="module")
def trials(spark):
    """Each source is a trial with documents of the same sizes; every third one has the same target."""
    sizes = [2, 3, 3, 4, 5, 7, 8, 11, 13, 16, 40, 41]
    rows = [(t * 100 + i, f"s{t:05}", "w " * s) for t in range(3000) for i, s in enumerate(sizes)]
    by_trial = defaultdict(list)
    for r in mix(table(spark, rows)).collect():
        by_trial[r.source].append(r)
    return sizes, by_trial


def test_inclusion_shares_are_the_probabilities(trials):
    sizes, by_trial = trials
    squares = []
    for weight in range(3):
        some = [rows for s, rows in by_trial.items() if int(s[1:]) % 3 == weight]
        target = some[0][0].target
        whole = int(target // sum(sizes))
        p = plain_odds(sizes, target - whole * sum(sizes))
        taken = Counter(r.doc_id % 100 for rows in some for r in rows for _ in range(r.copies - whole))
        assert all(r.copies - whole in (0, 1) for rows in some for r in rows)
        for i, q in enumerate(p):
            if q in (0.0, 1.0):
                assert taken[i] == q * len(some)
            else:
                squares.append((taken[i] / len(some) - q) ** 2 / (q * (1 - q) / len(some)))
    assert max(squares) < 3**2 and 0.3 < sum(squares) / len(squares) < 2


def test_sample_sizes_are_fixed(trials):
    sizes, by_trial = trials
    for rows in by_trial.values():
        target = rows[0].target
        whole = int(target // sum(sizes))
        expected = sum(plain_odds(sizes, target - whole * sum(sizes)))
        assert abs(sum(r.copies - whole for r in rows) - expected) < 1
        assert abs(sum(r.taken for r in rows) - target) < max(sizes)


@pytest.mark.parametrize("seed", ["a", "b", "c"])
def test_equal_rows_are_split(spark, seed):
    rows = [(7, "one", "w " * 10)] * 400 + [(i, "one", "w " * 10) for i in range(1000, 1600)]
    rows += [(i, "two", "w " * 10) for i in range(2000, 3000)]
    docs = table(spark, rows)
    taken, target, copies = Counter(), {}, Counter()
    for r in mix(docs, seed).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        copies[r.doc_id] += r.copies
    assert all(abs(taken[s] - target[s]) <= 10 for s in target)
    assert 220 < copies[7] < 310  # two thirds of 400
    for parts in (1, 7):
        again = Counter(r.doc_id for r in mixture(docs.repartition(parts), seed).collect())
        assert again == +copies


def test_sources_without_words_and_single_documents(spark):
    rows = [(1, None, None), (2, "a", ""), (3, "b", "w"), (4, "c", "w " * 1000), (None, "c", "w"), (None, "c", "w")]
    got = mix(table(spark, rows)).collect()
    assert len(got) == 6 and all(r.taken == r.copies * r.size and r.copies <= 3 for r in got)
    assert {r.copies for r in got if r.source in (None, "a")} == {0}


def test_seeds_differ_and_reruns_agree(spark):
    rng = random.Random(3)
    docs = table(spark, [(i, rng.choice("abc"), "w " * rng.randint(1, 300)) for i in range(2000)])
    first, again, other = ({r.doc_id: r.copies for r in mix(docs, s).collect()} for s in ("x", "x", "y"))
    assert first == again != other
