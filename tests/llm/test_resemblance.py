"""The pipeline's near duplicates against brute force: recall over lengths and seeds, dense groups of which many pairs are dissimilar, odd rows."""

import numpy as np
import pytest

from lintlake.llm import resemblance


def shingles(text, k=5):
    w = text.split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(texts):
    """The component of each text, by all pairs."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = []
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
                pairs.append((b, a))
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(i) for i in range(len(texts))], pairs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_recall_of_edited_words(spark, seed):
    """Zipf-drawn words, 40 to 1,000 of them, some replaced: pairs at 0.8 and more."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" + "ab" * (i % 4) for i in range(5000)])
    p = 1 / np.arange(1, 5001)
    p /= p.sum()
    rows, pairs = [], []
    for i in range(500):
        size = int(rng.choice([40, 80, 150, 400, 1000]))
        line = rng.choice(vocabulary, size, p=p)
        other = line.copy()
        for at in rng.choice(size, int(rng.integers(1, max(2, size // 40))), replace=False):
            other[at] = rng.choice(vocabulary, p=p)
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(other))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((2 * i, 2 * i + 1))
    got = {r["id"]: r["component"] for r in resemblance.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = sum(got[a] == got[b] for a, b in pairs)
    print(f"{met} of {len(pairs)} pairs")
    assert len(pairs) > 250 and met >= 0.98 * len(pairs) and all(got[i] // 2 == i // 2 for i in got)


def test_chance_and_sketch():
    assert resemblance.meeting_chance(0.8) > 0.998
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (rng.integers(-(1 << 63), 1 << 63, int(rng.integers(1, 400))) for _ in range(2))
        a, b = np.unique(np.append(a, b[: len(b) // 2])), np.unique(b)
        bits = int(np.bitwise_count((resemblance.sketch(a) ^ resemblance.sketch(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) and bits <= 64 * resemblance.SKETCH


def test_dense_groups(spark):
    """Copies of one text with 0 to 40 of 150 words replaced: most pairs share keys and few are similar enough."""
    rng = np.random.default_rng(9)
    line = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
    texts = []
    for _ in range(260):
        other = list(line)
        for at in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            other[at] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(other))
    texts += texts[:40]
    expected, pairs = brute(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component"] for r in resemblance.groups(frame).orderBy("id").collect()]
    linked = {i for p in pairs for i in p}
    assert len(pairs) > 500 and sum(g == e for g, e in zip(got, expected, strict=True)) >= 0.99 * len(texts)
    assert all(got[i] == i for i in range(len(texts)) if i not in linked)


def test_nothing_of_the_corpus_is_broadcast(spark, monkeypatch):
    """Every table that the search writes, and its result: Spark takes the keys of a few documents for as small as the documents."""
    plans = []
    write = resemblance.materialize

    def noted(df, what):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, what)

    monkeypatch.setattr(resemblance, "materialize", noted)
    line = " ".join(f"w{i}" for i in range(60))
    found = resemblance.one_of_each(spark.createDataFrame([(k, f"{line} {k}") for k in range(9)] + [(20, "alone"), (21, "alone")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == [0, 20]
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert len(plans) > 6 and [what for what, plan in plans if "Broadcast" in plan] == []


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long, 1), (3, long + " more", 2), (3, "another text", 3), (3, "another text", 3), (None, long, 4), (None, "alone", 5), (None, "alone", 5), (8, None, 6), (2, "", 7), (9, " \n", 8), (9, "One", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    kept = sorted(map(tuple, resemblance.one_of_each(frame).collect()), key=repr)
    assert kept == sorted([(3, long + " more", 2), (3, "another text", 3), (None, "alone", 5), (2, "", 7), (9, "One", 9)], key=repr)
    assert resemblance.one_of_each(frame.limit(0)).count() == 0 and resemblance.one_of_each(frame).columns == frame.columns


def test_every_row_has_a_component(spark):
    rows = [(1, "a b c"), (1, "d e f"), (4, "A  B c"), (None, "a b c"), (None, "x")]
    got = sorted((tuple(r) for r in resemblance.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (4, 1), (None, 1), (None, None)], key=repr)
