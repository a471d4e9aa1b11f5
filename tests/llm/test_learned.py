"""Learned partitions: recall against brute force on the given table, exact rows where a query's parts hold all, odd vectors, hot vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import learned
from lintlake.llm.common import table


def brute(rows, asks, k):
    """Query id -> its k best (vec_id, score), by sums component by component."""
    out = []
    for n, (q, v) in enumerate(rows):
        if asks(q):
            found = []
            for m, (i, w) in enumerate(rows):
                if m != n and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w, strict=True):
                        s += a * b
                    found.append((-s, i))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


BAD = [(20, None), (40, [0.0] * 4), (60, [1.0, None, 1.0, 1.0]), (80, [math.nan, 1.0, 1.0, 1.0]), (100, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (120, [])]


def test_all_rows_where_the_parts_hold_them_all(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(150)] + [(1000 + i, [0.5, 0.25, 0.125, 1.0]) for i in range(90)] + [(20, [0.5, 0.25, 0.125, 1.0]), (20, [0.1, 0.2, 0.3, 0.4])]
    rows = [r for r in rows if r[0] not in (40, 60, 80, 100, 120)] + [(2000, [1.0, 2.0]), (2020, [-1.0, 3.0]), (2040, [7.0])]
    frame = spark.createDataFrame(rows + BAD, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)
    want = brute(rows, lambda q: q % 20 == 0, 20)
    for options in ({}, {"vector_rows": 16, "query_rows": 3}):
        assert sorted(map(tuple, learned.nearest(frame, F.col("vec_id") % 20 == 0, **options).collect())) == want
    assert learned.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert learned.nearest(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_every_query_gets_k_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.standard_normal(8)).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ix_rows = learned.vectors(frame, F.col("vec_id") % 20 == 0)
    ix = learned.index(ix_rows, *learned.fit(ix_rows, parts=12))
    assert ix.router.parts == 12 and ix.sizes.sum() == 3000
    # a network that is sure of one part only: parts are asked until they hold enough rows
    ix.router.cover = 1e-9
    got = learned.search(ix, 400).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {400} and len(got) == 150


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_the_given_table(spark, sf_dir):
    frame = table(spark, sf_dir, "embeddings")
    rows = frame.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    asked = np.flatnonzero(ids % 20 == 0)
    true = learned.neighbours(x, 20, asked)
    got = {}
    for q, rank, i, s in learned.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(q, []).append((rank, i, s))
    assert set(got) == set(ids[asked].tolist()) and all(sorted(r for r, _, _ in v) == list(range(1, 21)) for v in got.values())
    recall = np.mean([len({i for _, i, _ in got[ids[q]]} & set(ids[near].tolist())) / 20 for q, near in zip(asked, true, strict=True)])
    assert recall >= 0.92
    for q, found in list(got.items())[:20]:
        assert all(math.isclose(s, float(x[q] @ x[i]), abs_tol=1e-12) for _, i, s in found)


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 16)) * 3
    x = centres[rng.integers(0, 8, 2000)] + rng.standard_normal((2000, 16))
    near = learned.neighbours(x, 10)
    part = learned.balanced_parts(x, near, 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(1.05 * 250)
    at_random = rng.permutation(part)
    assert (part[near] != part[:, None]).mean() < 0.5 * (at_random[near] != at_random[:, None]).mean()
