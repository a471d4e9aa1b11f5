"""Exact top-k inner products by a vector-approximation file.

The approximation is a table: for each vector one byte a component, the number of its cell between the component's quantiles. Cells and their ends are the same for the whole table. Queries meet codes only: the ends
of the cells bound a product from both sides, and what can't reach the k-th best lower bound is left there. The exact vectors of the rest are then read in the order of
their bounds, in rounds, until no unread one can reach the k-th exact score. An exact vector is never copied for a block of queries; it is read by its number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import drop_folder, materialize

#: Cells of a component; rows of codes and queries of a task's cell; rows from which the quantiles are taken, which changes speed and no result; exact vectors of the first round for each result.
CELLS, CODE_ROWS, QUERY_ROWS, SAMPLE, FIRST = 256, 65_536, 2048, 20_000, 4
SCALE = 256


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, v: floor(scale * x) of each component; rows whose id or vector is null, or whose vector holds a null or non-finite component or one whose multiple is no long integer, are left out."""
    v = F.col(vector_col)
    most = float(2**63 // scale)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < most))
    return table.filter(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _rows(column) -> np.ndarray:
    """The lists of an Arrow column as rows of long integers."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _coded(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    codes = np.empty(v.shape, np.uint8)
    for d in range(v.shape[1]):
        codes[:, d] = np.searchsorted(edges[d], v[:, d], "right")
    return codes


def cells(vectors: DataFrame, dim: int, count: int = CELLS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between the cells of each component (from a sample of the rows, drawn by hash), and the least and greatest value of any row in each cell (from all rows)."""
    drawn = vectors.orderBy(F.xxhash64("number"), "number").limit(max(1, min(sample, 8_000_000 // max(1, dim)))).select("v")
    taken = [r["v"] for r in drawn.toLocalIterator()]
    edges = np.quantile(np.array(taken, np.float64), np.linspace(0, 1, count + 1)[1:-1], axis=0).T.copy() if dim else np.zeros((0, count - 1))

    def ends(batches):
        low, high = np.full((dim, count), np.iinfo(np.int64).max), np.full((dim, count), np.iinfo(np.int64).min)
        at = np.arange(dim)
        for b in batches:
            v = _rows(b.column(0))
            codes = _coded(v, edges)
            np.minimum.at(low, (at, codes), v)
            np.maximum.at(high, (at, codes), v)
        d, c = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(c), pa.array(low[d, c]), pa.array(high[d, c])], ["d", "c", "low", "high"])

    found = vectors.select("v").mapInArrow(ends, "d long, c long, low long, high long").groupBy("d", "c").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.zeros((2, dim, count))
    for r in found.toLocalIterator():  # a row for each cell of each component
        low[r["d"], r["c"]], high[r["d"], r["c"]] = r["low"], r["high"]
    return edges, low, high


def bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of each query with any vector that has a row's codes, a little wider than doubles may err."""
    at = np.arange(codes.shape[1])
    floor, ceiling = low[at, codes].T, high[at, codes].T
    q = queries.astype(np.float64)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    err = (codes.shape[1] + 4) * 2.0**-51 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).max(1, initial=0.0))[:, None]
    return plus @ floor + minus @ ceiling - err, plus @ ceiling + minus @ floor + err


def _candidates(codes: np.ndarray, numbers: np.ndarray, queries: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, step: int = 64):
    """(query, number, least, most) of the rows of a block that may be among a query's k best of the block."""
    out = []
    for i in range(0, len(queries), step):
        least, most = bounds(queries[i : i + step], codes, low, high)
        own = asked[i : i + step, None] == numbers
        least[own], most[own] = -np.inf, -np.inf
        n = min(k, len(numbers))
        sure = np.partition(least, len(numbers) - n, axis=1)[:, len(numbers) - n]  # n rows reach this in any case
        q, row = np.nonzero((most >= sure[:, None]) & ~own)
        out.append((asked[i + q], numbers[row], least[q, row], most[q, row]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _met(rows: DataFrame, asks: DataFrame, dim: int, k: int, code_rows: int, query_rows: int) -> DataFrame:
    """query, number, least, most of every pair whose bounds leave it in question, for vectors of one length."""
    edges, low, high = cells(rows, dim)

    def code(batches):
        for b in batches:
            c = _coded(_rows(b.column(1)), edges)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in c], pa.binary())], ["number", "code"])

    codes = materialize(rows.select("number", "v").mapInArrow(code, "number long, code binary"), "codes")
    n, asked = codes.count(), asks.count()
    blocks, q_blocks = max(1, -(-n // code_rows)), max(1, -(-asked // query_rows))
    deal = lambda count, salt: F.pmod(F.xxhash64("number", F.lit(salt)), F.lit(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = codes.select(deal(blocks, 1).alias("block"), each(q_blocks).alias("q_block"), "number", "code")
    right = asks.select(each(blocks).alias("block"), deal(q_blocks, 2).alias("q_block"), "number", "v")

    def run(held: pa.Table, ask: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        if held.num_rows and ask.num_rows:
            coded = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(held.num_rows, dim)
            found = _candidates(coded, held["number"].to_numpy(), _rows(ask["v"]), ask["number"].to_numpy(), low, high, k)
        return pa.table([pa.array(x) for x in found], ["query", "number", "least", "most"])

    keys = ("block", "q_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, number long, least double, most double")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, code_rows: int = CODE_ROWS, query_rows: int = QUERY_ROWS, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (id, v) where `queries` holds, the k other rows with the greatest inner product.

    Fewer than k candidates give all of them; ties go to smaller ids. Vectors are compared with those of the same length only; empty ones have products
    of 0. Each row of a repeated id is a query and a candidate of its own. Scores are exact; one that doesn't fit a long integer is an error. An empty table gives an empty one.
    """
    sized = vectors.select("id", "v", F.size("v").alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("number"))
    sized = materialize(sized, "vectors")
    # of equal vectors only those of the k + 1 smallest ids can be among the k best of any query
    equal = Window.partitionBy("v").orderBy("id", "number")
    kept = materialize(sized.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1).drop("nth"), "kept")
    asks = sized.filter("asks")
    pairs = None
    for r in sized.select("dim").distinct().collect():  # lengths of vectors, of which a table has few
        dim = F.col("dim") == r["dim"]
        met = _met(kept.filter(dim), asks.filter(dim), r["dim"], k, code_rows, query_rows)
        pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # blocks decided for themselves: now by the k-th best lower bound of all of them
    pairs = materialize(pairs, "pairs")
    nth = Window.partitionBy("query").orderBy(F.desc("least"), "number")
    sure = pairs.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k).groupBy("query").agg(F.when(F.count("*") == k, F.min("least")).alias("sure"))
    place = Window.partitionBy("query").orderBy(F.desc("most"), "number")
    pending = pairs.join(sure, "query").filter(F.col("sure").isNull() | (F.col("most") >= F.col("sure"))).select("query", "number", "most", F.row_number().over(place).alias("place"))
    pending = materialize(pending, "pending")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id", "number")
    asked = asks.select(F.col("number").alias("query"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
    found, upto = None, first * k
    while True:
        read = pending.filter(F.col("place") <= upto).join(kept.select("number", "id", "v"), "number").join(asked, "query").select("query", "number", "id", product.alias("score"))
        read = read if found is None else read.unionByName(found)
        ranked = materialize(read.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
        found = ranked.drop("rank")
        # unread ones count only where they may reach the k-th score; an equal bound may still win its tie
        worst = ranked.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
        rest = pending.filter(F.col("place") > upto).join(worst, "query").filter(F.col("worst").isNull() | (F.col("most") >= F.col("worst"))).select("query", "number", "most", "place")
        before, pending, upto = pending, materialize(rest, "pending"), upto * 4
        drop_folder(before)
        if pending.isEmpty():
            break
    names = asks.select(F.col("number").alias("query"), F.col("id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")
