import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.llm import components, golay, registry, resemblance, simhash
from lintlake.llm.common import table
from lintlake.llm.components import connected_components


def plain(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(root)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(b)] = find(a)
    return {f: find(f) for f in known}


def agree(rows):
    """rows: (id, fp, component) against brute force."""
    same = classes({f & (2**64 - 1) for _, f, _ in rows})
    least = {}
    for i, f, _ in rows:
        c = same[f & (2**64 - 1)]
        least[c] = min(i, least.get(c, i))
    return all(c == least[same[f & (2**64 - 1)]] for _, f, c in rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**23 - 1), st.integers(0, 22), st.integers(0, 22))
def test_golay_balls_meet(word, i, j):
    other = word ^ 1 << i ^ (1 << j if i != j else 0)
    a, b = (set(golay.ball(np.array([w]), 23)[1].tolist()) for w in (word, other))
    assert a & b
    assert golay.decode(np.array([word]))[0] in range(4096)


def test_golay_is_perfect():
    assert np.bincount(golay.decode(np.arange(1 << 23)), minlength=4096).tolist() == [2048] * 4096


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB \t\n\x0bé ", max_size=40))
def test_fingerprint(text):
    assert simhash.simhash(text) == plain(text)


def test_long_text_is_counted_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(3000))
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.simhash(text) == plain(text)


def near_prints(seed=5):
    """Distinct fingerprints in dense and sparse clusters, and far ones."""
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(6):
        base = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(40):
            out.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    return sorted(out | {int(x) for x in rng.integers(0, 2**63, 60)})


def test_links_whatever_the_crowd(spark):
    fps = near_prints()
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for crowd in (1024, 2):
        label = {r["node"] & (2**64 - 1): r["label"] & (2**64 - 1) for r in connected_components(simhash.links(frame, crowd)).collect()}
        expected = classes(fps)
        pairs = {(f, g) for f in fps for g in fps if f < g and expected[f] == expected[g]}
        assert pairs == {(f, g) for f in fps for g in fps if f < g and label.get(f, f) == label.get(g, g)}


def test_query_against_brute_force(spark, sf):
    rows = registry.op4_simhash_neardup(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts) and all(r["fingerprint"] == f"{plain(texts[r['doc_id']]):016x}" for r in rows)
    assert agree([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows])


def test_odd_rows(spark):
    rows = [(5, None, "a"), (3, "", "b"), (9, " \n", "c"), (7, "one two", "d"), (7, "one two", "d"), (8, "ONE  two", "e"), (1, "x " * 5000, "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["id"], r["component"]) for r in simhash.near_duplicates(frame).collect())
    assert got == [(1, 1), (3, 3), (5, 3), (7, 7), (7, 7), (8, 7), (9, 3)]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def jobs_of(spark, work):
    """work's result and the number of jobs that it took."""
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    out = work()
    return out, scheduler.numTotalJobs() - before


def test_components_grow_from_earlier_ones(spark):
    """Links that come later are worked on between the groups found so far: same result, and links inside a group cost one job's steps, not a new search."""
    links = [(i, i + 1) for i in range(40) if i != 20] + [(100, 90), (90, 95)]
    later = [(20, 21), (95, 200), (300, 301), (301, 7), (3, 9)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known, first = jobs_of(spark, lambda: connected_components(frame(links)))
    known, inside = jobs_of(spark, lambda: connected_components(frame([(3, 9), (30, 22), (90, 95)]), known))
    assert inside < first / 3
    got = {r["node"]: r["label"] for r in connected_components(frame(later), known).collect()}
    assert got == {r["node"]: r["label"] for r in connected_components(frame(links + later)).collect()}
    assert got == {**dict.fromkeys([*range(41), 300, 301], 0), **dict.fromkeys([90, 95, 100, 200], 90)}


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """Labels take hardly any room in Parquet, so Spark would send tables of any number of them through the driver."""
    edges, known = spark.range(9).selectExpr("id a", "id + 1 b"), spark.range(10).selectExpr("id node", "id % 2 label")
    plan = lambda large: components._between(edges, known, large)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(True) and "BroadcastHashJoin" in plan(False)
    monkeypatch.setattr(components, "LARGE", 0)
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(30, 20)], "a long, b long")
    assert {r["node"]: r["label"] for r in connected_components(links).collect()} == {**dict.fromkeys(range(10), 0), 20: 20, 30: 20}


def test_fingerprints_are_not_broadcast(spark):
    """Tables with a row for each fingerprint are as large as the corpus; however small their files are, they don't go through the driver."""
    frame = spark.createDataFrame([(i, f"text {i // 2}") for i in range(10)], "doc_id long, text string")
    found = simhash.near_duplicates(frame)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["component"]) for r in found.collect()) == [(i, i - i % 2) for i in range(10)]


def test_keys_and_words_are_not_broadcast(spark):
    """Spark takes the keys of a few fingerprints, and the words near them, for as small as the fingerprints; in either branch of links() nothing goes through the driver."""
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in near_prints()], "fp long")
    for crowd in (1024, 2):
        assert "Broadcast" not in simhash.links(frame, crowd)._jdf.queryExecution().executedPlan().toString()


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_resemblance_against_brute_force(spark):
    """All classes of exact five-word Jaccard similarity, among texts edited lightly and heavily."""
    rng = np.random.default_rng(1)
    vocabulary = [f"w{int(x):x}" + "ab" * int(x % 3) for x in rng.integers(0, 10**6, 3000)]
    texts = []
    for _ in range(12):
        base = [str(w) for w in rng.choice(vocabulary, 150)]
        for edits in (0, 0, 1, 2, 25, 40):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, "kept out"), (1002, "tiny"), (1003, "Tiny")]
    got = {r["id"]: r["component"] for r in resemblance.groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1))).collect()}
    root = {i: i for i in got}
    given_rows = [(i, t or "") for i, t in rows if i is not None]
    for x, (i, a) in enumerate(given_rows):
        for j, b in given_rows[x + 1 :]:
            if jaccard(a, b) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    wrong = [i for i in got if got[i] != root[i]]
    assert len(wrong) <= 1 and all(got[i] == i for i in wrong), wrong  # a search by fingerprints may miss a pair, and joins no strangers
