"""Documents that resemble each other: SimHash candidates by Golay-code fuzzy hashing, then exact shingle similarity.

A fingerprint of five-word shingles finds pairs that differ little: it is cut into three segments, and a key joins one segment as it is with a codeword
index around another, so two documents meet if one segment is equal and another differs in 2 bits or fewer. At a similarity of 0.8 ten bits
or so differ, which such keys seldom bridge, so each document has keys of hash-selected parts too: a part is the four shingles that come first in
four orders by hash, and its fingerprint is a key as it is. Two documents agree on a part with probability similarity ** 4, wherever they differ, and on one of
twelve parts with probability 0.998 at 0.8. A key has 33 bits or more, so strangers seldom share one.

Groups of near copies can be large, and two of their members may well be less similar than 0.8, so pairs under a key aren't listed. In each of
two rounds every key draws a pivot, each document is compared with the eight pivots nearest to it, and what is similar is contracted; that joins dense groups
with a few comparisons a document. The documents that still stand under a key with a stranger to their group are then joined exactly, by prefixes:
shingles in the order of how many of these documents hold them, rarest first; similar sets share one of the first fifth, at a place early
enough in both. A document with many shingles of its own so drops out without a comparison, and pairs inside a group aren't looked at. A sketch of 256
parities bounds from below in how many shingles two sets differ, so pairs that can't be similar enough don't leave the join. Every comparison is an exact Jaccard similarity of sets of five-word shingles of whole texts.

Every table here has rows for each document, some of them many that Spark's estimates don't see (a Python map's output counts as so many rows as its input, and what repeats takes hardly any
room in Parquet), so joins are merged and nothing is broadcast through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import golay
from lintlake.llm.common import drop_folder, materialize, string_col
from lintlake.llm.components import connected_components
from lintlake.llm.simhash import EQUAL, SEGMENTS

SHINGLE, SIMILARITY = 5, 0.8
#: Hash-selected parts of a text, and the shingles in each.
PARTS, PART_SHINGLES = 12, 4
#: Rounds of pivots, and the comparisons of a document in each; what they leave is joined exactly.
ROUNDS, NEAREST = 2, 8
#: Words of 64 bits in a sketch.
SKETCH = 4
ORDERS = np.random.default_rng(5).integers(0, 1 << 64, PARTS * PART_SHINGLES, np.uint64) | np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(hashes: np.ndarray) -> np.int64:
    """A bit is 1 if set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).view(">u8")[0].astype(np.uint64).view(np.int64)


def shingle_hashes(line: list[bytes], k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive words (of all words, if fewer)."""
    if len(line) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(line))], np.uint64)
    own = {w: xxhash.xxh64_intdigest(w) for w in set(line)}
    h = np.fromiter(map(own.__getitem__, line), np.uint64, len(line))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * PRIME
        out ^= out >> np.uint64(32)
    return out


def part_keys(hashes: np.ndarray) -> np.ndarray:
    """A negative number for each hash-selected part, so that it differs from every key of a fingerprint's segments."""
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1 << 12):
        h = hashes[i : i + (1 << 12), None] * ORDERS
        h ^= h >> np.uint64(32)
        h *= PRIME
        least = np.minimum(least, h.min(axis=0))
    out = np.zeros(PARTS, np.uint64)
    for chosen in least.reshape(PARTS, PART_SHINGLES).T:
        out = (out ^ chosen) * PRIME
        out ^= out >> np.uint64(31)
    out ^= np.arange(PARTS, dtype=np.uint64)
    return (out | np.uint64(1 << 63)).view(np.int64)


def segment_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the fingerprints' segments: (position of the fingerprint, key)."""
    raw = [prints >> s & ((1 << w) - 1) for s, w in SEGMENTS]
    balls = [golay.ball(r, w) for r, (_, w) in zip(raw, SEGMENTS, strict=True)]
    keys = [tag << 40 | raw[x][balls[y][0]] << 12 | balls[y][1] for tag, (x, y) in enumerate(EQUAL)]
    return np.concatenate([balls[y][0] for _, y in EQUAL]), np.concatenate(keys)


def _classes(texts: DataFrame, shingle: int) -> DataFrame:
    """class, print and parts of each row of (class, text)."""

    def run(batches):
        for b in batches:
            prints, parts = [], []
            for t in b.column(1):
                h = shingle_hashes(words(t.as_py()), shingle)
                prints.append(fingerprint(h))
                parts.append(part_keys(h))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.array(parts, np.int64).ravel()), PARTS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(prints, np.int64)), lists], ["class", "print", "parts"])

    return texts.mapInArrow(run, "class binary, print long, parts array<long>")


def _keys(classes: DataFrame) -> DataFrame:
    """key, rep: about 45 rows for each row of classes (rep, print, parts)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                rep = part.column(0).to_numpy(zero_copy_only=False)
                who, keys = segment_keys(part.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rep[who])], ["key", "rep"])
                yield pa.RecordBatch.from_arrays([part.column(2).flatten(), pa.array(np.repeat(rep, PARTS))], ["key", "rep"])

    return classes.select("rep", "print", "parts").mapInArrow(run, "key long, rep long")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles falls in each of 64 * SKETCH bins: sketches of two sets differ in as many bits as the sets in elements, or fewer."""
    odd = np.bincount((shingles & np.int64(64 * SKETCH - 1)), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """class, shingles (distinct 64-bit hashes) and their sketch of each row of (class, text)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                sets = [np.unique(shingle_hashes(words(t.as_py()), shingle)).view(np.int64) for t in part.column(1)]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                sketches = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([sketch(x) for x in sets])), SKETCH).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, sketches], ["class", "shingles", "sketch"])

    return texts.mapInArrow(run, "class binary, shingles array<long>, sketch array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar enough."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("shingles").alias(f"{side}_set")).hint("merge"), side)
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.filter(both >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def _labelled(rows: DataFrame, known: DataFrame | None, rep: str, label: str) -> DataFrame:
    """rows with the label of their group so far: a node without links is its own."""
    if known is None:
        return rows.withColumn(label, F.col(rep))
    return rows.join(known.select(F.col("node").alias(rep), F.col("label").alias(f"__{label}")).hint("merge"), rep, "left").withColumn(label, F.coalesce(f"__{label}", rep)).drop(f"__{label}")


def _met(busy: DataFrame, known: DataFrame | None, prints: DataFrame, draw: int, tried: list[DataFrame]) -> DataFrame:
    """a, b: each document with the nearest of the pivots that its keys draw outside of its group."""
    order = F.xxhash64("rep", "key", F.lit(draw))
    pivots = busy.groupBy("key").agg(F.min_by("rep", order).alias("pivot"))
    rows = busy.join(pivots.hint("merge"), "key").select("rep", "pivot").filter("rep <> pivot").distinct()
    rows = _labelled(_labelled(rows, known, "rep", "label"), known, "pivot", "pivot_label").filter("label <> pivot_label").select("rep", "pivot")
    rows = rows.join(prints.hint("merge"), "rep").join(prints.select(F.col("rep").alias("pivot"), F.col("print").alias("pivot_print")).hint("merge"), "pivot")
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("pivot_print")))
    nearest = Window.partitionBy("rep").orderBy("apart", "pivot")
    rows = rows.select("rep", "pivot", apart.alias("apart")).withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= NEAREST)
    pairs = rows.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    for t in tried:
        pairs = pairs.join(t.hint("merge"), ["a", "b"], "left_anti")
    return pairs


def _mixed(busy: DataFrame, known: DataFrame | None) -> DataFrame:
    """rep, label of the documents that share a key with a document of another group."""
    rows = _labelled(busy, known, "rep", "label")
    mixed = rows.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("key")
    return rows.join(mixed.hint("merge"), "key", "left_semi").select("rep", "label").distinct()


def _prefix_pairs(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: every pair of rest (rep, label) of different groups that can be similar enough, by the shingles that come first in both."""
    rows = rest.join(sets.hint("merge"), "rep").select("rep", "label", F.size("shingles").alias("n"), "sketch", F.explode("shingles").alias("shingle"))
    held = rows.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1")
    rows = rows.join(held.hint("merge"), "shingle")
    place, all_of = Window.partitionBy("rep").orderBy("held", "shingle"), Window.partitionBy("rep")
    at = F.col("n") - F.count("*").over(all_of) + F.row_number().over(place) - 1  # those that no other document holds come first
    first = rows.withColumn("at", at).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9)).select("shingle", "rep", "label", "n", "at", *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)))
    first = materialize(first, "prefixes")
    x, y = first.alias("x"), first.alias("y")
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label"))
    enough = left >= (F.col("x.n") + F.col("y.n")) * F.lit(similarity / (1 + similarity)) - 1e-6
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH)), F.lit(0))
    close = differ <= (F.col("x.n") + F.col("y.n")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    return x.join(y.hint("merge"), meet & enough & close).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def text_class(text):
    """A 128-bit digest of a text: rows of equal texts are one class."""
    return F.unhex(F.md5(text.cast("binary")))


def class_groups(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """class (of text_class), component of every distinct text: texts have one component if a chain of similar ones joins them.

    Null counts as empty, and texts without words are alike. Repeated rows add nothing; other columns are ignored. An empty table gives an empty one.
    """
    texts = docs.select(string_col(docs, text_col).alias("text")).select(text_class(F.col("text")).alias("class"), "text")
    marked = _classes(texts, shingle).groupBy("class").agg(F.first("print").alias("print"), F.first("parts").alias("parts"))
    classes = materialize(marked.withColumn("rep", F.monotonically_increasing_id()), "classes")
    shared = _keys(classes).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    busy = materialize(_keys(classes).join(shared.hint("merge"), "key"), "busy")
    some = busy.select("rep").distinct().join(classes.select("rep", "class").hint("merge"), "rep").select("class", "rep")
    sets = _sets(texts.join(some.hint("merge"), "class", "left_semi"), shingle).groupBy("class").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
    sets = materialize(sets.join(some.hint("merge"), "class").select("rep", "shingles", "sketch"), "sets")
    prints, known, tried = classes.select("rep", "print"), None, []
    for draw in range(ROUNDS):
        pairs = materialize(_met(busy, known, prints, draw, tried), "pairs")
        tried.append(pairs)
        known = connected_components(_similar(pairs, sets, similarity), known)
    rest = materialize(_mixed(busy, known), "rest")
    more = materialize(_prefix_pairs(rest, sets, similarity), "pairs")
    known = connected_components(_similar(more, sets, similarity), known)
    out = materialize(_labelled(classes.select("class", "rep"), known, "rep", "component").select("class", "component"), "groups")
    for t in (busy, sets, classes, rest, *tried):
        drop_folder(t)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id, component of every row: the smallest id reached over documents of at least that similarity.

    A row without an id has its component too: null where no row of the group has an id. Rows of one id and different texts each have their own
    row. Null and empty texts form a class; other columns are ignored. An empty table gives an empty one.
    """
    found = class_groups(docs, text_col, shingle, similarity)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_class(string_col(docs, text_col)).alias("class"))
    least = rows.groupBy("class").agg(F.min("id").alias("least")).join(found.hint("merge"), "class").groupBy("component").agg(F.min("least").alias("least"))
    return rows.join(found.join(least.hint("merge"), "component").select("class", F.col("least").alias("component")).hint("merge"), "class").select("id", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, with all columns: the one of least id (a row without an id only where none has one), of several the one of least text digest.

    Rows are told apart by id and text, so rows of one id and different texts count each for itself, and one of equal rows stays. Null and
    empty texts form a class. Columns may have any names. An empty table gives an empty one.
    """
    found = class_groups(docs, text_col, shingle, similarity)
    key, of = "row_key", "class"
    while key in docs.columns or of in docs.columns:
        key, of = key + "_", of + "_"
    text, who = string_col(docs, text_col), F.col(f"`{id_col}`").cast("long")
    row_key = F.unhex(F.md5(F.concat(F.coalesce(who.cast("string"), F.lit("none")), F.lit(":"), text).cast("binary")))
    rows = docs.select(row_key.alias("key"), text_class(text).alias("class"), who.alias("id")).join(found.hint("merge"), "class")
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("class"), F.col("key"))).alias("best")
    keep = rows.groupBy("component").agg(best).select(F.col("best.key").alias(key))
    return docs.withColumn(key, row_key).join(keep.hint("merge"), key).dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns))


def meeting_chance(similarity: float) -> float:
    """Probability that two documents of that similarity agree on one part at least."""
    return 1 - math.pow(1 - similarity**PART_SHINGLES, PARTS)
