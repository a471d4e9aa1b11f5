"""Near-duplicate documents by SimHash, searched with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of 4 differing bits, at most 2 lie in the two cleanest
segments, so for any two linked fingerprints either one segment is equal and another differs in 2 bits or fewer, or two
segments differ in one bit each. Keys of the first kind join an equal segment with each codeword index around the other one;
keys of the second kind join the indices around one segment with the index of the other (the two sides swap roles). Fingerprints
that meet under a key are verified by their true distance in the join itself.

Only distinct fingerprints are searched. Keys that more than `crowd` fingerprints hold aren't joined: their fingerprints
are linked through the words within 2 bits of each (two fingerprints are within 4 bits exactly if they share such a word), whose
groups can't exceed the 2,081 words of a ball. Work stays linear in the number of fingerprints however dense they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm import golay
from lintlake.llm.common import materialize, string_col
from lintlake.llm.components import connected_components

#: (shift, width) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: An equal segment and one within 2 bits; two segments within 1 bit.
EQUAL, NEAR = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), ((0, 1), (0, 2), (1, 2))
RADIUS = 4
CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of the whole text: A-Z lower-cased, words between ASCII white space, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = np.array([hash64(line[s:e], seed) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of every row. A null text counts as empty; an empty one has fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = np.array([simhash(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), string_col(docs, text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position of the fingerprint, key and role of each key: roles 0 and 1 meet each other, 2 meets its own kind."""
    at, keys, roles = [], [], []
    raw = [fps >> s & ((1 << w) - 1) for s, w in SEGMENTS]
    own = [golay.decode(r) for r in raw]
    near = [golay.ball(r, w) for r, (_, w) in zip(raw, SEGMENTS, strict=True)]

    def put(tag, i, left, right, role):
        at.append(i)
        keys.append(tag << 40 | left << 12 | right)
        roles.append(np.full(len(i), role, np.int8))

    for tag, (a, b) in enumerate(EQUAL):
        i, index = near[b]
        put(tag, i, raw[a][i], index, 2)
    for tag, (a, b) in enumerate(NEAR, len(EQUAL)):
        i, index = near[a]
        put(tag, i, index, own[b][i], 0)
        i, index = near[b]
        put(tag, i, own[a][i], index, 1)
    return np.concatenate(at), np.concatenate(keys), np.concatenate(roles)


def keys(fps: DataFrame) -> DataFrame:
    """key, role, fp: about 64 rows for each row of fps (column fp)."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                fp = b.column(0).slice(k, 2048).to_numpy(zero_copy_only=False)
                at, key, role = _keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(fp[at])], ["key", "role", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, role byte, fp long")


def _mids(fps: DataFrame) -> DataFrame:
    """mid, fp: the words within 2 bits of each fingerprint."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([[np.uint64(0)], one, one[i] | one[j]]).view(np.int64)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 64):
                fp = b.column(0).slice(k, 64).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel()), pa.array(np.repeat(fp, len(flips)))], ["mid", "fp"])

    return fps.select("fp").mapInArrow(run, "mid long, fp long")


def _first_tag() -> F.Column:
    """The least tag under which fingerprints x and y must meet, so that a pair comes from few keys."""
    d = [F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")).bitwiseAND(F.lit(((1 << w) - 1) << s if s + w < 64 else -(1 << s)))) for s, w in SEGMENTS]
    out = F
    for tag, (a, b) in enumerate(EQUAL):
        out = out.when((d[a] == 0) & (d[b] <= 2), tag)
    for tag, (a, b) in enumerate(NEAR, len(EQUAL)):
        out = out.when((d[a] <= 1) & (d[b] <= 1), tag)
    return out


def links(fps: DataFrame, crowd: int = 1024) -> DataFrame:
    """a, b: links whose components are those of all pairs of distinct fingerprints (column fp) at 4 differing bits or fewer.

    Keys and words are 64 and 2,081 rows for each fingerprint, which Spark's estimate of a Python map's output doesn't see, so they are merged and never broadcast.
    """
    found = keys(fps)
    crowded = materialize(found.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded")
    more = None
    if not crowded.isEmpty():
        dense = materialize(found.join(crowded.hint("merge"), "key", "left_semi").select("fp").distinct(), "dense")
        mids = _mids(dense)
        least = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("mid", "a")
        more = mids.join(least.hint("merge"), "mid").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()
        found = found.join(crowded.hint("merge"), "key", "left_anti")
    x, y = found.filter("role != 1").alias("x"), found.filter("role != 0").alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & ((F.col("x.role") == 2) == (F.col("y.role") == 2))
    meet &= (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS) & (F.shiftright("x.key", 40) == _first_tag())
    pairs = x.join(y.hint("merge"), meet).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    return pairs if more is None else pairs.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, crowd: int = 1024) -> DataFrame:
    """id, fp, component: the smallest id reachable over fingerprints that differ in 4 bits or fewer, itself included.

    Whole texts, any number of copies; null and empty texts share fingerprint 0 and so one component; repeated ids keep
    their rows. Other columns are ignored. An empty table gives an empty one.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    linked = links(distinct, crowd)
    for side in ("a", "b"):
        to = distinct.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep")).hint("merge")  # as large as the corpus, so not broadcast
        linked = linked.join(to, side)
    classes = connected_components(linked.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    owners = distinct.join(classes.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component"))
    return marked.join(owners.hint("merge"), "fp").select("id", "fp", "component")
