"""Documents that are a benchmark item less some of its words."""

import numpy as np

from lintlake.llm import decontam


def test_truncated_items_as_whole_documents():
    rng = np.random.default_rng(6)
    items = [(i, [f"t{x}" for x in rng.integers(0, 10**6, size)]) for i, size in enumerate([59, 59, 40, 30, 14, 14])]
    words = decontam._Words()
    bags = [np.unique(decontam.shingles(words.of(" ".join(w)), 5), return_counts=True) for _, w in items]
    index = decontam.Index([(i, len(w), h, n, np.full(len(h), 2.9)) for (i, w), (h, n) in zip(items, bags, strict=True)], 2.9)
    for i, w in items:
        for text in (w[:-1], w[1:], w[: -(len(w) // 20)] if len(w) >= 20 else w, w[1:-1] if len(w) > 14 else w):
            (found,) = index.search(words.of(" ".join(text)))
            assert found[:3] == (i, 0, len(text)) and found[4] >= 0.8
        assert not index.search(words.of(" ".join(w[: len(w) // 2])))
    assert not index.search(words.of("")) and not index.search(words.of(" ".join(items[0][1][:3])))
