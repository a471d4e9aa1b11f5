"""Language-model scores of each document by the counts of the others."""

import math
from collections import Counter

import pytest

from lintlake.llm import backoff, registry
from lintlake.llm.common import table


def brute(rows, order, alpha=0.4):
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    everything, total = Counter(), sum(len(w) for _, w in rows)
    for _, w in rows:
        everything.update(grams(w))
    out = {}
    for i, w in rows:
        own = grams(w)
        rest = lambda g: everything[g] - own[g]

        def one(g):
            if len(g) == 1:
                return math.log(max(1, rest(g)) / max(1, total - len(w)))
            return math.log(rest(g) / rest(g[:-1])) if rest(g) else math.log(alpha) + one(g[1:])

        n, s = out.get(i, (0, 0.0))
        out[i] = (n + len(w), s + sum(one(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w))))
    return out


@pytest.mark.parametrize(("order", "block_words", "partition_keys"), [(2, 1 << 20, 1 << 22), (3, 700, 5000), (4, 5000, 1000)])
def test_held_out(spark, sf, order, block_words, partition_keys):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(120)
    odd = [(900, None), (901, ""), (902, "One"), (902, "one two"), (None, "no id"), (None, "no id at all"), (903, "long word " * 3000)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + odd
    expected = brute([(i, (t or "").encode().lower().split()) for i, t in rows], order)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_tokens"], r["log_score"]) for r in backoff.held_out_scores(frame, order, block_words=block_words, partition_keys=partition_keys).collect()}
    assert got.keys() == expected.keys() and all(got[i][0] == n and got[i][1] == pytest.approx(s) for i, (n, s) in expected.items())
    assert backoff.held_out_scores(frame.limit(0), order).count() == 0


def test_gibberish_is_not_predictable(spark, tmp_path):
    prose = "the cat sat on the mat and the dog sat on the rug near the door of the old house"
    rows = [(i, prose) for i in range(5)] + [(9, " ".join(f"zq{i}x" for i in range(len(prose.split()))))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.op7_stupid_backoff(spark, str(tmp_path)).collect()}
    assert got[9]["log_score"] < got[0]["log_score"] - 10
    assert all(r["mean_log_score"] == pytest.approx(r["log_score"] / r["n_tokens"]) for r in got.values())


def test_documents_that_occur_twice_stand_apart(spark, sf):
    """The mean a word tells documents with a copy from those without, whatever their lengths."""
    docs = table(spark, sf, "documents").select("doc_id", "text").filter("length(text) > 200").dropDuplicates(["text"]).orderBy("doc_id").limit(150)
    copies = docs.filter("doc_id % 5 = 0").selectExpr("doc_id + 1000000 AS doc_id", "text")
    got = {r["id"]: r["mean_log_score"] for r in backoff.held_out_scores(docs.unionByName(copies)).collect()}
    twice, once = sorted(got[i] for i in got if i % 5 == 0), sorted(got[i] for i in got if i % 5)
    assert twice[0] > once[int(0.9 * len(once))]
