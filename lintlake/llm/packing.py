"""Length buckets of least padding, and batches under a token budget inside each.

Bucket boundaries come from dynamic programming over the histogram of all lengths (rounded up to `align`), so its size is bounded by the longest
text, not by the number of rows. Rows are numbered inside a bucket by ranges of their order: each range numbers its own rows, and the
counts of the ranges before are added. No task holds a bucket, nor all rows of one id.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import materialize, placed, string_col

BUCKETS, BUDGET, ALIGN = 12, 16_384, 8


def word_count(column):
    """Words between white space, and one end mark."""
    return (F.regexp_count(column, F.lit(r"\S+")) + 1).cast("long")


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding in all: (length, rows) in any order, lengths distinct.

    Exact: the cost of a bucket is its upper end times its rows less its tokens; the best last boundary for each end is found with a hull of
    lines, since their slopes (rows so far) and the ends only grow. Ties go to fewer buckets, then to smaller lower ends.
    """
    pairs = sorted(histogram)
    if not pairs:
        return []
    rows, tokens = [0], [0]
    for length, n in pairs:
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + n * length)
    m = len(pairs)
    best: list[int | None] = [0] + [None] * m
    came: list[list[int]] = []
    totals: list[int] = []
    for _ in range(min(buckets, m)):
        hull: deque[tuple[int, int, int]] = deque()  # slope, constant, boundary
        now: list[int | None] = [None] * (m + 1)
        back = [0] * (m + 1)
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                k, c = -rows[j - 1], best[j - 1] + tokens[j - 1]
                while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - k) >= (c - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((k, c, j - 1))
            if hull:
                x = pairs[j - 1][0]
                while len(hull) >= 2 and hull[1][0] * x + hull[1][1] < hull[0][0] * x + hull[0][1]:
                    hull.popleft()
                now[j] = hull[0][0] * x + hull[0][1] + x * rows[j] - tokens[j]
                back[j] = hull[0][2]
        best = now
        came.append(back)
        totals.append(now[m])
    used = totals.index(min(totals))
    ends, j = [], m
    for layer in range(used, -1, -1):
        ends.append(pairs[j - 1][0])
        j = came[layer][j]
    return ends[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length=None, buckets: int = BUCKETS, budget: int = BUDGET, align: int = ALIGN) -> DataFrame:
    """id, n_tokens, bucket, bucket_tokens, batch, slot, padding of every row.

    length: a column expression for the tokens of a row; words and an end mark by default. A batch of a bucket holds budget //
    bucket_tokens rows, one at least, filled in order of the ids' hashes, ids and tokens; only a bucket's last batch may be short. Rows that agree in id and
    tokens can change places unseen, so batches depend neither on the layout of files nor on the number of tasks, and rows of one id, or without any, lie in as many ranges as
    they fill. Padding is least for lengths rounded up to `align`. Null and empty texts have one token; repeated rows are all packed; other columns are ignored. An empty table gives an empty one.
    """
    size = word_count(string_col(docs, text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    sized = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(size, F.lit(1)).alias("n_tokens")), "lengths")
    histogram = sized.groupBy((F.ceil(F.col("n_tokens") / align) * align).cast("long").alias("length")).count().collect()
    ends = boundaries([(r["length"], r["count"]) for r in histogram], buckets)
    bucket = F
    for i, end in enumerate(ends):
        bucket = bucket.when(F.col("n_tokens") <= end, i)
    bucket = bucket.otherwise(None) if ends else F.lit(None)
    capacity = F.element_at(F.array(*(F.lit(max(1, budget // e)) for e in ends)), F.col("bucket") + 1) if ends else F.lit(None)
    top = F.element_at(F.array(*(F.lit(e) for e in ends)), F.col("bucket") + 1) if ends else F.lit(None)
    # the last column tells equal rows apart, or they would all fall into one range
    dealt = sized.select("id", "n_tokens", bucket.cast("int").alias("bucket"), F.xxhash64("id").alias("deal"), F.monotonically_increasing_id().alias("copy"))
    rows = placed(dealt, "bucket", ["deal", "id", "n_tokens", "copy"])
    return rows.select(
        "id", "n_tokens", "bucket", top.cast("long").alias("bucket_tokens"), F.floor(F.col("place") / capacity).cast("long").alias("batch"), (F.col("place") % capacity).cast("int").alias("slot"), (top - F.col("n_tokens")).cast("long").alias("padding")
    )
