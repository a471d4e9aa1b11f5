"""Near copies that differ by a block of words."""

import numpy as np
import pytest

from lintlake.llm import resemblance


def jaccard(a, b, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("cut", [False, True])
def test_resemblance_of_added_and_cut_blocks(spark, cut):
    """Pairs that differ by one block, at similarity 0.8 to 0.95, against brute force."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{int(x):x}" + "ab" * int(x % 3) for x in rng.integers(0, 10**6, 3000)]
    rows, pairs = [], []
    for i in range(400):
        size, share = int(rng.choice([80, 150, 400, 1000])), (0.8, 0.85, 0.9, 0.95)[i % 4] + 0.005
        line = [str(w) for w in rng.choice(vocabulary, size)]
        block = size - int(size * share)
        at = int(rng.choice([0, size - block, rng.integers(0, size - block)])) if cut else size - block
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(line[:at] + line[at + block :]))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            pairs.append((2 * i, 2 * i + 1))
    got = {r["id"]: r["component"] for r in resemblance.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = sum(got[a] == got[b] for a, b in pairs)
    print(f"{met} of {len(pairs)} pairs")
    assert len(pairs) > 300 and met >= 0.98 * len(pairs)
    assert all(got[i] // 2 == i // 2 for i in got)
