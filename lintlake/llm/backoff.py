"""Stupid-backoff language-model scores, computed relationally.

An n-gram's score is c(n-gram) / c(its context) where the count table holds it, else `alpha` times the score of the n-gram without its
first word, down to c(word) / N; a document's score is the sum of logarithms. Words are lower-cased (A-Z) runs without ASCII white space; n-grams are 64-bit
hashes of their words.

`held_out_scores`, the registered query, scores each row by the counts of all rows less its own, so an n-gram that no other row holds backs off. Rows
stand in blocks of a bounded number of words. A block counts its own n-grams first, so a frequent n-gram is one entry of a block however often it
occurs, and sends them to the count tables, which are partitioned by hash: a partition gets at most `partition_keys` n-grams as they occur in
the corpus, so it fits a task. There the counts of all blocks meet and go back to the blocks, whose rows are then scored. Every n-gram of every row takes part.

In a partition an n-gram is known by 40 further bits of its hash. As partitions grow in number with the corpus, a stranger has the same bits with
a probability of partition_keys / 2 ** 40, 2 in a million, at every size.

`score` joins the exploded n-grams of any documents to count tables partitioned by hash, order by order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import string_col

ALPHA, ORDER = 0.4, 3
#: A word, as bytes.split() cuts.
WORD = r"[^ \t\n\r\x0b\f]+"
#: Words in a block (a longer row is a block of its own), n-grams of a partition of the count tables, bits of an n-gram in it.
BLOCK_WORDS, PARTITION_KEYS, BITS = 1 << 20, 1 << 21, 40
PRIME = np.uint64(0x9E3779B97F4A7C15)
CACHE = 1 << 19


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, with the order mixed in."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(size, n, np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + size]) * PRIME
        h ^= h >> np.uint64(31)
    return h


def _arrow(*columns) -> list:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), string_col(docs, text_col).alias("text"))


def counts(docs: DataFrame, order: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n of every n-gram of that order in all texts, partitioned by key. Each batch of rows counts its own first."""

    def run(batches):
        words = _Words()
        for b in batches:
            found = [grams(words.of(t.as_py()), order) for t in b.column(1)]
            key, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(_arrow(key, n), ["key", "n"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, tables: list[DataFrame], alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, log_score by the count tables of orders 1, 2, ...: each has columns key and n.

    A word that no table holds counts as seen once. Rows without words have n_tokens 0 and log_score 0. Repeated ids are added up as one document; other columns are ignored.
    """
    top = len(tables)
    total = max(1, tables[0].agg(F.sum("n")).first()[0] or 0)

    def run(batches):
        words = _Words()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                w = words.of(t.as_py())
                cols = [pa.repeat(i, len(w)), pa.array(np.minimum(np.arange(len(w)) + 1, top).astype(np.int32))]
                for n in range(1, top + 1):  # the n-gram that ends at each word, 0 where there is none
                    cols += _arrow(np.concatenate([np.zeros(min(n - 1, len(w)), np.uint64), grams(w, n)]))
                for n in range(1, top):  # its context: the n words before
                    cols += _arrow(np.concatenate([np.zeros(min(n, len(w)), np.uint64), grams(w, n)[: max(0, len(w) - n)]]))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", "most", *(f"g{n}" for n in range(1, top + 1)), *(f"h{n}" for n in range(1, top))]
    texts = _texts(docs, id_col, text_col)
    rows = texts.mapInArrow(run, ", ".join(["id long", "most int", *(f"{c} long" for c in names[2:])]))
    for n in range(1, top + 1):
        rows = rows.join(tables[n - 1].select(F.col("key").alias(f"g{n}"), F.col("n").alias(f"c{n}")), f"g{n}", "left")
        if n < top:
            rows = rows.join(tables[n - 1].select(F.col("key").alias(f"h{n}"), F.col("n").alias(f"d{n}")), f"h{n}", "left")
    value = F.log(F.coalesce("c1", F.lit(1)) / F.lit(total))
    for n in range(2, top + 1):
        held = F.col(f"c{n}").isNotNull() & F.col(f"d{n - 1}").isNotNull()
        value = F.when(F.col("most") < n, value).when(held, F.log(F.col(f"c{n}") / F.col(f"d{n - 1}"))).otherwise(value + float(np.log(alpha)))
    sums = rows.groupBy("id").agg(F.count("*").alias("n_tokens"), F.sum(value).alias("log_score"))
    none = texts.select("id").distinct()
    return none.join(sums, none["id"].eqNullSafe(sums["id"]), "left").select(none["id"], F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))


def _squeeze(values: np.ndarray) -> bytes:
    """An array of integers, its bytes by place and compressed: places that hold zeros cost nothing."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _restore(raw: bytes, kind: type) -> np.ndarray:
    places = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(places.T).view(kind)[:, 0] if places.size else np.zeros(0, kind)


def _blocks(texts: DataFrame, block_words: int) -> DataFrame:
    """block (a number), ids, sizes (words of each row), vocabulary (hashes) and words (places in it) of blocks of rows (id, text)."""

    def pack(rows, block):
        ids, lines = zip(*rows, strict=True)
        vocabulary, at, seen = np.unique(np.concatenate(lines), return_inverse=True, return_counts=True)
        often = np.argsort(-seen, kind="stable")  # so that most places are small numbers
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often))
        sizes = np.array([len(x) for x in lines], np.uint32)
        cols = [pa.array([block], pa.int64()), pa.array([list(ids)], pa.list_(pa.int64())), *(pa.array([_squeeze(x)], pa.binary()) for x in (sizes, vocabulary[often], place[at]))]
        return pa.RecordBatch.from_arrays(cols, ["block", "ids", "sizes", "vocabulary", "words"])

    def run(batches):
        words, rows, n, block = _Words(), [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                line = words.of(t.as_py())
                if rows and n + len(line) > block_words:
                    yield pack(rows, block)
                    rows, n, block = [], 0, block + 1
                rows.append((i, line))
                n += len(line)
        if rows:
            yield pack(rows, block)

    return texts.mapInArrow(run, "block long, ids array<long>, sizes binary, vocabulary binary, words binary")


def _block_grams(sizes: np.ndarray, vocabulary: np.ndarray, at: np.ndarray, order: int, shift: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the n-grams of a block that lie inside a row: (place of the last word, key)."""
    words, row = vocabulary[at], np.repeat(np.arange(len(sizes)), sizes)
    out = []
    for n in range(1, order + 1):
        h = grams(words, n)
        inside = np.flatnonzero(row[: len(h)] == row[n - 1 :][: len(h)])
        out.append((inside + n - 1, h[inside] >> np.uint64(shift)))
    return out


def _read_block(block, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(_restore(block[c][i].as_py(), t) for c, t in (("sizes", np.uint32), ("vocabulary", np.uint64), ("words", np.uint32)))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the distinct ones in ascending order, and how often each of those occurs."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return where, np.diff(np.append(np.flatnonzero(first), len(keys)))


def held_out_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, partition_keys: int = PARTITION_KEYS) -> DataFrame:
    """id, n_tokens, log_score and its mean a word of every document, each row by the counts of all rows less its own: as score() gives with the tables of the other rows.

    A word that no other row holds counts as seen once. block_words and partition_keys bound a task's memory and change no score. Null and empty
    texts have n_tokens 0 and log_score 0; the scores of repeated ids are added up; other columns are ignored. An empty table gives an empty one.
    """
    texts = _texts(docs, id_col, text_col)
    total = texts.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    # both the n-grams and the scores read every column of the blocks, so that one exchange serves them
    blocks = _blocks(texts, block_words).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    parts_bits = max(0, (total * order // partition_keys).bit_length())
    shift = 64 - BITS - parts_bits  # a key is a partition's bits and the bits inside it

    def own(batches):
        for b in batches:
            for i in range(b.num_rows):
                keys = np.concatenate([k for _, k in _block_grams(*_read_block(b, i), order, shift)])
                keys, n = np.unique(keys, return_counts=True)
                ends = np.searchsorted(keys, np.arange(1, (1 << parts_bits) + 1, dtype=np.uint64) << np.uint64(BITS))
                ends[-1] = len(keys)
                starts = np.concatenate([[0], ends[:-1]])
                full = np.flatnonzero(ends > starts)
                for at in range(0, len(full), 64):
                    some = full[at : at + 64]
                    inside = [keys[starts[p] : ends[p]] & np.uint64((1 << BITS) - 1) for p in some]
                    packed = [_squeeze(np.diff(k, prepend=np.uint64(0))) for k in inside]
                    counted = [_squeeze(n[starts[p] : ends[p]].astype(np.uint32)) for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.repeat(b["block"][i], len(some)), pa.array(packed, pa.binary()), pa.array(counted, pa.binary())], ["part", "block", "keys", "counts"])

    def count(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(_restore(k.as_py(), np.uint64), dtype=np.uint64) for k in group["keys"]]
        held, where = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([_restore(c.as_py(), np.uint32) for c in group["counts"]])
        others = np.bincount(where, n, len(held)).astype(np.uint32)[where] - n
        cut = np.split(others, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"part": group["part"], "block": group["block"], "counts": pa.array([_squeeze(c) for c in cut], pa.binary())})

    def scored(block: pa.Table, counts: pa.Table) -> pa.Table:
        sizes, vocabulary, at = _read_block(block, 0)
        sizes = sizes.astype(np.int64)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        found = _block_grams(sizes, vocabulary, at, order, shift)
        places = [p.astype(np.int32) for p, _ in found]
        keys = np.concatenate([k for _, k in found])
        del found, vocabulary, at
        where, own = _groups(keys)
        del keys
        by = np.argsort(counts["part"].to_numpy())
        everywhere = np.concatenate([np.zeros(0, np.uint32), *(_restore(counts["counts"][int(i)].as_py(), np.uint32) for i in by)]).astype(np.int64) + own
        inside, sums = _groups(row[np.concatenate(places)].astype(np.int64) * max(1, len(own)) + where)
        rest = everywhere[where] - sums[inside]  # what the other rows hold
        del where, inside
        value, context, start = np.zeros(len(row)), None, 0
        for n, ends in enumerate(places, 1):
            now = np.zeros(len(row), np.int64)
            now[ends] = rest[start : start + len(ends)]
            start += len(ends)
            if n == 1:
                value = np.log(np.maximum(now, 1) / np.maximum(1, total - sizes[row]))
            else:
                seen = now[ends] > 0
                value[ends] = np.where(seen, np.log(np.maximum(now[ends], 1) / np.maximum(context[ends - 1], 1)), value[ends] + np.log(alpha))
            context = now
        return pa.table({"id": block["ids"][0].values, "n_tokens": pa.array(sizes), "log_score": pa.array(np.bincount(row, value, len(sizes)))})

    sent = blocks.mapInArrow(own, "part long, block long, keys binary, counts binary")
    back = sent.groupBy("part").applyInArrow(count, "part long, block long, counts binary")
    both = blocks.groupBy("block").cogroup(back.groupBy("block"))
    out = both.applyInArrow(scored, "id long, n_tokens long, log_score double")
    sums = out.groupBy("id").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("log_score").alias("log_score"))
    return sums.withColumn("mean_log_score", F.col("log_score") / F.greatest(F.col("n_tokens"), F.lit(1)))
