"""Approximate nearest neighbours by learned partitions of the space.

A bounded sample of the vectors gives a neighbour graph. The graph is cut into parts of nearly equal size with few edges between them, and a small network learns
how a vector's neighbours spread over the parts. It then gives every row of the table its part, and every query the order of the parts in which its neighbours are likely.
How much probability a query has to cover is measured on sample rows kept from the training, against brute force.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import materialize

#: Rows that teach, nearest of a row in the graph, parts for a sample of each size and their greatest number, how far a part may pass the mean size.
SAMPLE, NEAREST, ROWS_A_PART, PARTS, SLACK = 10_000, 20, 300, 32, 0.05
HIDDEN, EPOCHS, RATE = 128, 15, 3e-3
#: The share of true neighbours that the probed parts have to hold on held-out sample rows.
RECALL = 0.96
#: Numbers that the sample may hold; rows and queries of a cell.
NUMBERS = 4_000_000
VECTOR_ROWS, QUERY_ROWS = 16_384, 16_384


def neighbours(x: np.ndarray, k: int, asked: np.ndarray | None = None, step: int = 512) -> np.ndarray:
    """The k rows of x with the greatest inner product with each asked row (all by default), without itself; nearest first."""
    asked = np.arange(len(x)) if asked is None else asked
    k = min(k, len(x) - 1)
    out = np.empty((len(asked), k), np.int64)
    for i in range(0, len(asked), step):
        own = asked[i : i + step]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(own), 0), np.int64)
        out[i : i + step] = np.take_along_axis(best, np.argsort(-np.take_along_axis(s, best, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = SLACK, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """A part for every vertex of the neighbour graph (edges both ways), none larger than (1 + slack) of the mean.

    It starts from splits at medians of the direction in which a part's vectors differ most, so sizes are equal; then vertices move to the part that holds most of their neighbours, those that gain most
    first, while there is room, or trade places.
    """
    n = len(x)
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(centred[:: max(1, len(rows) // 2000)], full_matrices=False)[2][0]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        left = count // 2
        cut = len(order) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    source, target = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    source, target = np.append(source, target), np.append(target, source)
    room = int(np.ceil((1 + slack) * n / parts))
    sizes = np.bincount(part, minlength=parts)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        held = np.bincount(source * parts + part[target], minlength=n * parts).reshape(n, parts)
        best = held.argmax(1)
        gain = held[np.arange(n), best] - held[np.arange(n), part]
        order = np.flatnonzero(gain > 0)
        order = order[np.argsort(-gain[order] + rng.random(len(order)) * 0.5)]
        moved, waiting = 0, {}
        for v in order.tolist():
            a, b = int(part[v]), int(best[v])
            if sizes[b] < room:
                sizes[a] -= 1
                sizes[b] += 1
                part[v] = b
                moved += 1
            elif waiting.get((b, a)):  # one that wants to go the other way
                u = waiting[(b, a)].pop()
                part[v], part[u] = b, a
                moved += 2
            else:
                waiting.setdefault((a, b), []).append(v)
        if moved < max(1, n // 500):
            break
    return part


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Router:
    """The network: one hidden layer, and the share of probability that a query's parts have to reach."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    cover: float = 1.0

    @property
    def parts(self) -> int:
        return len(self.b2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2)

    @classmethod
    def fit(cls, x: np.ndarray, spread: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Router:
        """On rows x and the shares of their neighbours in each part, by Adam steps on the cross entropy."""
        rng = np.random.default_rng(seed)
        p = [rng.standard_normal((x.shape[1], hidden)) * (2 / x.shape[1]) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, spread.shape[1])) * (1 / hidden) ** 0.5, np.zeros(spread.shape[1])]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), 256):
                at = order[i : i + 256]
                h = np.maximum(x[at] @ p[0] + p[1], 0)
                d2 = (_softmax(h @ p[2] + p[3]) - spread[at]) / len(at)
                d1 = (d2 @ p[2].T) * (h > 0)
                t += 1
                step = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
                for k, g in enumerate((x[at].T @ d1, d1.sum(0), h.T @ d2, d2.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(*p)


def shares(near: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """How each row's neighbours spread over the parts."""
    n = len(near)
    return np.bincount((np.arange(n)[:, None] * parts + part[near]).ravel(), minlength=n * parts).reshape(n, parts) / max(1, near.shape[1])


def learn(x: np.ndarray, parts: int | None = None, k: int = NEAREST, recall: float = RECALL, held_out: float = 0.2) -> Router:
    """A router for the sample x (rows of doubles, zero rows left out). Every fifth row doesn't teach; on those the cover is set so that the probed parts hold `recall` of the k nearest rows."""
    x = np.unique(x, axis=0)  # copies would be each other's neighbours
    x = x[np.random.default_rng(1).permutation(len(x))]
    parts = parts or int(min(PARTS, max(1, len(x) // ROWS_A_PART)))
    if parts < 2 or len(x) < 4 * parts:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbours(x, k)
    part = balanced_parts(x, near, parts)
    spread = shares(near, part, parts)
    taught = np.arange(len(x)) % max(2, round(1 / held_out)) != 0
    router = Router.fit(x[taught], spread[taught])
    # rows go by the network, so the cover is measured with the network's parts
    asked = np.flatnonzero(~taught)
    given = router.probabilities(x).argmax(1)
    p, true = router.probabilities(x[asked]), shares(near[asked], given, parts)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)  # probability of the parts probed before
    found = np.take_along_axis(true, order, 1)
    router.cover = next((c for c in np.linspace(0.3, 1.0, 141) if (found * (before < c)).sum(1).mean() >= recall), 1.0)
    return router


def vectors(table: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """number (of the row), id, v, dim, asks: rows that take part, as a table. Null, empty and zero vectors, vectors with null or non-finite components and rows without an id are left out."""
    v, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.filter(i.isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(i.cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"), F.coalesce(queries, F.lit(False)).alias("asks"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("number"), "*"), "vectors")


def _matrix(column) -> np.ndarray:
    """The lists of an Arrow column as rows; all of one length."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit(rows: DataFrame, sample: int = SAMPLE, numbers: int = NUMBERS, **options) -> tuple[int, Router]:
    """The commonest length of the vectors and a router learned from at most `sample` rows of it, drawn by hash, holding at most `numbers` numbers."""
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return 0, learn(np.zeros((0, 1)))
    drawn = rows.filter(F.col("dim") == common["dim"]).orderBy(F.xxhash64("number"), "number").limit(max(1, min(sample, numbers // common["dim"]))).select("v")
    return common["dim"], learn(np.array([r["v"] for r in drawn.toLocalIterator()]), **options)


@dataclass
class Index:
    """Every row with its part. rows: number, id, v, dim, asks, part; sizes: rows of each of the router's parts. Vectors of other lengths than the router's are parts of their own (-dim)."""

    dim: int
    router: Router
    rows: DataFrame
    sizes: np.ndarray


def index(rows: DataFrame, dim: int, router: Router) -> Index:
    def route(batches):
        for b in batches:
            lengths = b.column("dim").to_numpy()
            part = -lengths.astype(np.int64)
            own = np.flatnonzero(lengths == dim)
            if len(own):
                part[own] = router.probabilities(_matrix(b.column("v").take(pa.array(own)))).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    routed = materialize(rows.mapInArrow(route, "number long, id long, v array<double>, dim int, asks boolean, part long"), "routed")
    sizes = np.zeros(router.parts, np.int64)
    for r in routed.filter("part >= 0").groupBy("part").count().collect():  # one row a part
        sizes[r["part"]] = r["count"]
    return Index(dim, router, routed, sizes)


def probes(ix: Index, k: int) -> DataFrame:
    """number, id, v, part: each query once for every part that it asks: the most probable ones until the cover is reached and they hold k rows besides it."""
    dim, router, sizes = ix.dim, ix.router, ix.sizes

    def run(batches):
        for b in batches:
            lengths = b.column("dim").to_numpy()
            own, other = np.flatnonzero(lengths == dim), np.flatnonzero(lengths != dim)
            at, part = [other], [-lengths[other].astype(np.int64)]
            if len(own):
                p = router.probabilities(_matrix(b.column("v").take(pa.array(own))))
                order = np.argsort(-p, axis=1, kind="stable")
                before = lambda x: np.cumsum(x, 1) - x
                asked = (before(np.take_along_axis(p, order, 1)) < router.cover) | (before(sizes[order]) < k + 1)
                which, place = np.nonzero(asked & (sizes[order] > 0))
                at.append(own[which])
                part.append(order[which, place])
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("number", "id", "v")), pa.array(np.concatenate(part))], ["number", "id", "v", "part"])

    return ix.rows.filter("asks").mapInArrow(run, "number long, id long, v array<double>, part long")


def best(queries: np.ndarray, asked: np.ndarray, x: np.ndarray, numbers: np.ndarray, ids: np.ndarray, k: int, step: int = 128):
    """(position of the query, position of the row, score) of each query's k rows with the greatest products, ties to smaller ids.

    Products of whole blocks pick the rows; their scores are then summed component by component, so equal vectors get equal scores wherever they stand.
    """
    at, found, scores = [], [], []
    for i in range(0, len(queries), step):
        rough = queries[i : i + step] @ x.T
        rough[asked[i : i + step, None] == numbers] = -np.inf
        n = min(k, len(x))
        least = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n]
        scale = 1e-12 * np.abs(queries[i : i + step]).sum(1) * max(1e-300, np.abs(x).max())
        for q in range(len(rough)):
            rows = np.flatnonzero((rough[q] >= least[q] - scale[q]) & (rough[q] > -np.inf))
            exact = np.zeros(len(rows))
            for d in range(x.shape[1]):
                exact += queries[i + q, d] * x[rows, d]
            order = np.lexsort((numbers[rows], ids[rows], -exact))[:k]
            at.append(np.full(len(order), i + q))
            found.append(rows[order])
            scores.append(exact[order])
    if not at:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def search(ix: Index, k: int = 20, vector_rows: int = VECTOR_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows among the parts that each query asks, by inner product.

    A part's rows and queries are cut into blocks of bounded size, however large the part is, and every pair of blocks is a task's cell; the cells' best rows are merged.
    """
    asked = materialize(probes(ix, k), "probes")
    held, asking = ix.rows.groupBy("part").agg(F.count("*").alias("n")), asked.groupBy("part").agg(F.count("*").alias("m"))
    blocks = lambda c, size: F.ceil(F.col(c) / size).cast("long")
    cut = held.join(asking, "part").select("part", blocks("n", vector_rows).alias("blocks"), blocks("m", query_rows).alias("q_blocks"))
    # a row for each of the router's parts and each other length; hashes deal rows to blocks
    rows = ix.rows.join(F.broadcast(cut), "part") if _few(ix) else ix.rows.join(cut, "part")
    deal = lambda n, by: F.pmod(F.xxhash64("number", F.lit(by)), F.col(n))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.select("part", deal("blocks", 1).alias("block"), "q_blocks", "number", "id", "v").select("part", "block", copies("q_blocks").alias("q_block"), "number", "id", "v")
    right = (asked.join(F.broadcast(cut), "part") if _few(ix) else asked.join(cut, "part")).select("part", "blocks", deal("q_blocks", 2).alias("q_block"), "number", "id", "v").select("part", copies("blocks").alias("block"), "q_block", "number", "id", "v")

    def run(vecs: pa.Table, ask: pa.Table) -> pa.Table:
        if not vecs.num_rows or not ask.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        numbers, ids, own = vecs["number"].to_numpy(), vecs["id"].to_numpy(), ask["number"].to_numpy()
        at, found, scores = best(_matrix(ask["v"]), own, _matrix(vecs["v"]), numbers, ids, k)
        return pa.table([pa.array(a, t) for a, t in zip((ask["id"].to_numpy()[at], own[at], ids[found], numbers[found], scores), kinds, strict=True)], names)

    names, kinds = ["query_id", "query", "vec_id", "number", "score"], (*[pa.int64()] * 4, pa.float64())
    keys = ("part", "block", "q_block")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, query long, vec_id long, number long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _few(ix: Index, most: int = 1000) -> bool:
    """Whether there are few enough parts to send a row for each to every task."""
    return ix.router.parts + ix.rows.filter("part < 0").select("part").distinct().limit(most).count() < most


def nearest(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", vector_rows: int = VECTOR_ROWS, query_rows: int = QUERY_ROWS, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `queries` holds, its k nearest other rows that were found, by inner product in double precision.

    All rows are indexed; the router learns from a bounded sample (SAMPLE rows, NUMBERS numbers). Vectors meet those of their length only. A query gets k rows wherever there are as many, ties go to
    smaller ids, and a row of a repeated id is a query and a candidate of its own. Rows that take no part: see vectors(). Other columns are ignored, an empty table gives an empty one.
    """
    rows = vectors(table, queries, id_col, vector_col)
    return search(index(rows, *fit(rows, **options)), k, vector_rows, query_rows)
