"""Benchmark passages in documents: SimHash over item-sized windows, multi-index Hamming search, exact weighted-shingle check.

Words are runs of word characters in lower case. A window has as many words as a benchmark item; for items longer than the document the whole document is one window. Its 64-bit SimHash is
cut into four 16-bit blocks: of 15 differing bits at most 3 fall in the cleanest block, so every item within radius 15 is found among those whose block is
one of the 697 values within 3 bits of the window's. Those are compared exactly: weighted Jaccard similarity of the two bags of five-word shingles. A shingle of
the item weighs the less the more items of the whole benchmark hold it; one that the item lacks weighs as one that no item holds.

A window without any shingle of an item has similarity 0 to it, so only windows that hold one are fingerprinted.
How many items hold a shingle is counted over the whole benchmark in Spark. The index is built from slices of the benchmark of at most `slice_rows` items and
`slice_bytes` of text, and documents are scanned once a slice: what a task holds is bounded however large the benchmark is, and no result depends on the slices.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import drop_folder, materialize, string_col

WORD = re.compile(r"\w+")
SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
PRIME = np.uint64(0x9E3779B97F4A7C15)
REGION = 1 << 13
CACHE = 1 << 19


class _Words(dict):
    """Hashes of words, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of every k consecutive words."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(k):
            h = h * PRIME + words[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of `size` hashes that begins at one of starts (ascending)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + REGION)))
        low, part = starts[i], hashes[starts[i] : starts[j - 1] + size]
        sums = np.zeros((len(part) + 1, 64), np.int32)
        np.cumsum(np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, out=sums[1:])
        at = starts[i:j] - low
        out[i:j] = np.packbits(2 * (sums[at + size] - sums[at]) > size, axis=1).view(">u8")[:, 0]
        i = j
    return out


def _within(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


FLIPS = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(16), r)], np.int64)


class Index:
    """Of a slice of the benchmark: rows of (item, words, shingles ascending, their counts, their weights); new: the weight of a shingle that no item holds."""

    def __init__(self, rows: list[tuple], new: float):
        self.items = [r[0] for r in rows]
        self.bags = [tuple(np.array(x, t) for x, t in zip(r[2:], (np.uint64, np.float64, np.float64), strict=True)) for r in rows]
        self.new, self.size = new, np.array([r[1] for r in rows], np.int64)
        self.prints = np.array([self._simhash(*bag[:2]) for bag in self.bags], np.uint64)
        self.starts, self.members = [], []  # of each block: where the items of a value begin, items by value
        for b in range(BLOCKS):
            value = (self.prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
            self.members.append(np.argsort(value, kind="stable"))
            self.starts.append(np.searchsorted(value[self.members[-1]], np.arange((1 << 16) + 1)).astype(np.int32))
        k = np.minimum(self.size, SHINGLE)
        self.own = {int(n): np.unique(np.concatenate([self.bags[m][0] for m in np.flatnonzero(self.size == n)])) for n in np.unique(self.size)}
        self.by_k = {}  # all shingles of one length, and a table of their first bits
        for n in np.unique(k).tolist():
            own = np.unique(np.concatenate([self.bags[m][0] for m in np.flatnonzero(k == n)]))
            seen = np.zeros(1 << 20, bool)
            seen[own >> np.uint64(44)] = True
            self.by_k[n] = (own, seen)

    @staticmethod
    def _simhash(shingles: np.ndarray, counts: np.ndarray) -> int:
        bits = counts @ np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        return int(np.packbits(2 * bits > counts.sum()).view(">u8")[0])

    def similarity(self, window: np.ndarray, member: int) -> float:
        """Weighted Jaccard similarity of a window's shingles, repeats included, and an item's bag."""
        own, counts, weights = self.bags[member]
        held, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, held), len(own) - 1)
        known = own[at] == held
        there = np.zeros(len(own))
        there[at[known]] = n[known]
        both = weights @ np.minimum(there, counts)
        return both / (weights @ np.maximum(there, counts) + self.new * n[~known].sum())

    def lookup(self, fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs within RADIUS of items of that size: position in fps, member, distance."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(fps), 256):
            part = fps[first : first + 256]
            for b in range(BLOCKS):
                values = (part >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ FLIPS
                left, right = self.starts[b][values], self.starts[b][values + 1]
                i, f = np.nonzero(right > left)
                n = (right - left)[i, f]
                where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[i, f], n)
                at.append(first + np.repeat(i, n))
                found.append(self.members[b][where])
        i, m = np.concatenate(at), np.concatenate(found)
        fits = self.size[m] == size
        pairs = np.unique(i[fits] * len(self.items) + m[fits])
        i, m = pairs // len(self.items), pairs % len(self.items)
        d = np.bitwise_count(fps[i] ^ self.prints[m])
        keep = d <= RADIUS
        return i[keep], m[keep], d[keep]

    def search(self, words: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """The best window of each item in one document: item, first word, words, distance, similarity. Ties: the first."""
        best: dict[int, tuple] = {}
        for k, (known, seen) in self.by_k.items():
            h = shingles(words, k)
            near = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            near = near[_within(h[near], known)]
            if not len(near):
                continue
            for size, own in self.own.items():
                if min(size, SHINGLE) != k:
                    continue
                width = min(size, len(words))  # for an item longer than the document: all of it
                run = width - k + 1
                anchors = near[_within(h[near], own)]
                if not len(anchors):
                    continue
                edge = np.zeros(len(words) - width + 2, np.int64)  # windows that hold an anchor
                np.add.at(edge, np.clip(anchors - run + 1, 0, len(edge) - 1), 1)
                np.add.at(edge, np.clip(anchors + 1, 0, len(edge) - 1), -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if not len(starts):
                    continue
                i, member, d = self.lookup(fingerprints(h, starts, run), size)
                for s, m, dist in zip(starts[i].tolist(), member.tolist(), d.tolist(), strict=True):
                    sim = self.similarity(h[s : s + run], m)
                    if sim >= SIMILARITY - 1e-9 and (m not in best or (sim, -s) > (best[m][4], -best[m][1])):
                        best[m] = (self.items[m], s, width, dist, float(sim))
        return list(best.values())


def weighted_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """item, words, shingles, counts, weights of each item that has words, and the weight of a shingle that none holds; counted over all items."""

    def run(batches):
        words = _Words()
        for b in batches:
            out = []
            for i, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = words.of(t.as_py())
                if len(w):
                    h, n = np.unique(shingles(w, min(SHINGLE, len(w))), return_counts=True)
                    out.append((i, r, len(w), len(t.as_py()), h.view(np.int64), n.astype(np.int32)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["item", "row", "words", "chars", "shingles", "counts"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.monotonically_increasing_id().alias("row"), string_col(benchmark, text_col).alias("t"))
    items = materialize(rows.mapInArrow(run, "item long, row long, words long, chars long, shingles array<long>, counts array<int>"), "items")
    n = items.count()
    each = items.select("item", "row", "words", "chars", F.inline(F.arrays_zip("shingles", "counts")).alias("shingle", "n"))
    held = each.groupBy("shingle").agg(F.count("*").alias("held"))
    weight = 1 + F.log(F.lit(1 + n) / (1 + F.col("held")))
    bag = F.sort_array(F.collect_list(F.struct(F.col("shingle"), F.col("n"), weight.alias("weight"))))
    found = each.join(held, "shingle").groupBy("item", "row", "words", "chars").agg(bag.alias("bag"))
    return found.select("item", "words", "chars", F.col("bag.shingle").alias("shingles"), F.col("bag.n").alias("counts"), F.col("bag.weight").alias("weights")), float(1 + np.log(1 + n))


def slices(items: DataFrame, slice_rows: int, slice_bytes: int):
    """Bounded lists of items. Rows come to the driver one partition at a time."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        if rows and (len(rows) >= slice_rows or size + r["chars"] > slice_bytes):
            yield rows
            rows, size = [], 0
        by = np.argsort(np.array(r["shingles"], np.int64).view(np.uint64))
        rows.append((r["item"], r["words"], np.array(r["shingles"], np.int64).view(np.uint64)[by], np.array(r["counts"], np.int32)[by], np.array(r["weights"])[by]))
        size += r["chars"]
    if rows:
        yield rows


def _with_last(rows):
    """Each of rows with whether it is the last."""
    rows = iter(rows)
    now = next(rows, None)
    while now is not None:
        then = next(rows, None)
        yield now, then is None
        now = then


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_rows: int = 20_000, slice_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document row and item row it holds: id, item_id, start_word, n_words, distance, similarity of the best window.

    Null and empty texts hold nothing; an item of fewer than five words counts as one shingle, one without words never
    matches. Repeated document rows each give their rows; other columns are ignored. Empty tables give an empty one. slice_rows and slice_bytes change no row.
    """
    schema = "id long, item_id long, start_word long, n_words long, distance int, similarity double"
    texts = docs.select(F.col(id_col).cast("long").alias("id"), string_col(docs, text_col).alias("text"))
    items, new = weighted_items(benchmark, item_col, item_text)
    found = None
    for rows, last in _with_last(slices(items, slice_rows, slice_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            index, words = Index(shared.value, new), _Words()
            for b in batches:
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    out += [(i, *x) for x in index.search(words.of(t.as_py()))]
                cols = list(zip(*out, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "item_id", "start_word", "n_words", "distance", "similarity"])

        part = texts.mapInArrow(run, schema)
        if not last:  # one slice is alive at a time
            part = materialize(part, "found")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slice_rows: int = 20_000, slice_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all columns, that hold no item of the benchmark, each judged by its own text: ids may be null or repeated.

    Null and empty texts stay. Empty tables give what they hold.
    """
    mark = "text_read"
    while mark in docs.columns:
        mark += "_"
    items, new = weighted_items(benchmark, item_col, item_text)
    before = None
    for rows, last in _with_last(slices(items, slice_rows, slice_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared):
            index, words = Index(shared.value, new), _Words()
            for b in batches:
                clean = [not index.search(words.of(t.as_py())) for t in b.column(b.num_columns - 1)]
                yield b.filter(pa.array(clean, pa.bool_())).select(range(b.num_columns - 1))

        docs = docs.withColumn(mark, string_col(docs, text_col)).mapInArrow(run, docs.schema)
        if not last:  # one slice is alive at a time, and one table of what is still clean
            docs = materialize(docs, "clean")
            shared.destroy()
            if before is not None:
                drop_folder(before)
            before = docs
    return docs
