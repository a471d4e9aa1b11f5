"""Conversations as a prefix trie, with totals by leaf-peeling message passing.

Turns are dealt out by ranges of (conversation, turn), numbered inside the ranges, and known by a 128-bit hash of role and text. A node is known by its
depth and the exclusive or of the hashes of (place, turn) on its way from the root, so prefixes are running sums that can be cut anywhere: no task holds a conversation.

Each node belongs to the member whose hashed id is the least. The nodes of one owner follow each other on one path, so they are one unit of the message
passing: a unit holds a counter of units that hang on it and aren't done; units whose counter is zero send the totals of their subtree to the unit
above, until only the root's unit is left and finishes. Owners are drawn by hash, so a path changes its owner some ln(n) times whatever the order of ids and lengths.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import drop_folder, materialize, ranged

#: Conversations share turns inside groups of this many ids, and at most SHARED - 1 turns.
GROUP, SHARED = 100, 6
#: Ids of a piece of a node's list; depths of a stretch; parents with more than one in HEAVY of all nodes as children are told apart.
PIECE, STRETCH, HEAVY = 512, 4096, 1000


def _mixed(place: Column, k1: Column, k2: Column) -> tuple[Column, Column]:
    """A turn's hash at its place in a conversation, in two halves."""
    return F.xxhash64(place, k1, k2), F.xxhash64(k2, place, F.lit("second"), k1)


def numbered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, nth, k1, k2, chars) and stretches (conv_id, part, first, before, size) of every conversation.

    The turn's place is before + nth - first + 1. Order: turn (null first), then role and text, both empty where null. Rows without a conversation's id are left out.
    """
    name = lambda c: F.col(f"`{c}`")
    rows = messages.select(name(conv_col).cast("long").alias("conv_id"), name(turn_col).cast("long").alias("turn"), F.coalesce(name(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(name(text_col).cast("string"), F.lit("")).alias("text"))
    start = lambda c: F.left(F.col(c), F.lit(48))
    sorted_rows = ranged(rows.filter("conv_id IS NOT NULL"), [F.col("conv_id"), F.col("turn"), start("role"), start("text")], ["conv_id", "turn", "role", "text"])
    turns = sorted_rows.select("conv_id", "part", "nth", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("second"), F.col("text"), F.col("role")).alias("k2"), F.length("text").cast("long").alias("chars"))
    turns = materialize(turns, "turns")
    size = turns.groupBy("conv_id", "part").agg(F.min("nth").alias("first"), F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns, materialize(size.select("*", before.alias("before")), "stretches")


def rebuilt(turns: DataFrame, stretches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, length) after rebuilding, and their turns: conv_id, depth, p1, p2 (the prefix), q1, q2 (the prefix without the turn), chars."""
    place = F.col("before") + F.col("nth") - F.col("first") + 1
    heads = turns.join(stretches.filter(F.col("before") < SHARED - 1), ["conv_id", "part"]).select("conv_id", place.alias("place"), "k1", "k2", "chars").filter(F.col("place") < SHARED)
    x1, x2 = _mixed(F.col("place"), F.col("k1"), F.col("k2"))
    heads = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", x1.alias("x1"), x2.alias("x2"), "chars"))).alias("heads"))  # five at most
    own = stretches.groupBy("conv_id").agg(F.sum("size").alias("size"))
    own = own.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    known = own.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    known = known.withColumn("heads", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int"))).withColumn("m", F.size("heads").cast("long"))
    both = lambda c: F.aggregate("heads", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[c]))
    known = known.select("conv_id", "h", "m", "heads", both("x1").alias("h1"), both("x2").alias("h2"), (F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length"))
    known = materialize(known, "known")

    def before(c):
        return lambda x, i: F.aggregate(F.slice("heads", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a.bitwiseXOR(y[c]))

    shared = known.select("conv_id", F.inline(F.arrays_zip(F.transform("heads", before("x1")).alias("p1"), F.transform("heads", before("x2")).alias("p2"), F.col("heads"))))
    shared = shared.select("conv_id", F.col("heads.place").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("heads.x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("heads.x2")).alias("q2"), F.col("heads.chars").alias("chars"))

    # what a conversation has for itself: its turns' places move by m - h; running exclusive ors inside a stretch, and those of the stretches before
    pieces = stretches.join(known.select("conv_id", "h", "m", "h1", "h2"), "conv_id")
    rest = turns.join(pieces, ["conv_id", "part"]).filter(place > F.col("h")).select("conv_id", "part", "h1", "h2", (place - F.col("h") + F.col("m")).alias("depth"), "k1", "k2", "chars")
    y1, y2 = _mixed(F.col("depth"), F.col("k1"), F.col("k2"))
    rest = rest.select("conv_id", "part", "h1", "h2", "depth", "chars", y1.alias("x1"), y2.alias("x2"))
    sums = rest.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))))
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.join(sums, ["conv_id", "part"])
    prefix = [F.bit_xor(x).over(so_far).bitwiseXOR(F.col(b)).bitwiseXOR(F.col(h)) for x, b, h in (("x1", "b1", "h1"), ("x2", "b2", "h2"))]
    rest = rest.select("conv_id", "depth", prefix[0].alias("p1"), prefix[1].alias("p2"), "x1", "x2", "chars")
    rest = rest.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "chars")
    return known.select("conv_id", "length"), shared.unionByName(rest)


KEY = ["depth", "p1", "p2"]


@dataclass
class Trie:
    """nodes: depth, p1, p2 (together the node), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. ends: depth, p1, p2, conv_id of the conversations that end there."""

    nodes: DataFrame
    ends: DataFrame


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id and parent_owner. Parents with very many children, of whom there can't be more than HEAVY, are sent to every task; the join on the rest has no great key."""
    most = max(1, nodes.count() // HEAVY)
    above = nodes.select(*(F.col(a).alias(b) for a, b in zip(KEY, ("d", "q1", "q2"), strict=True)), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("parent_owner"), "n_children")
    heavy, light = above.filter(F.col("n_children") > most).drop("n_children"), above.filter((F.col("n_children") > 0) & (F.col("n_children") <= most)).drop("n_children")
    rows = nodes.withColumn("d", F.col("depth") - 1)
    first = rows.join(F.broadcast(heavy), ["d", "q1", "q2"], "left")  # at most HEAVY rows
    met, rest = first.filter("parent_owner IS NOT NULL OR depth = 0"), first.filter("parent_owner IS NULL AND depth > 0").drop("parent_conv_id", "parent_owner")
    return met.unionByName(rest.join(light, ["d", "q1", "q2"])).drop("d", "q1", "q2")


def peeled(units: DataFrame) -> DataFrame:
    """owner, above, at, leaves, saved: units (with remaining, the number of units that hang on each) with the totals of their subtrees, those of the units on them added.

    Each round, units with nothing left to wait for send their totals; sums by receiver are made before the join, so a unit with any number of others on it gets one message a round.
    """
    pending, done = units, None
    while True:
        ready = materialize(pending.filter("remaining = 0").drop("remaining"), "ready")
        done = ready if done is None else done.unionByName(ready)
        sent = ready.filter("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("n"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")).withColumnRenamed("above", "owner")
        waiting = pending.filter("remaining > 0").join(sent, "owner", "left")
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        waiting = materialize(waiting.select("owner", "above", "at", (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining"), plus("leaves", "more_leaves"), plus("saved", "more_saved")), "waiting")
        if pending is not units:
            drop_folder(pending)
        pending = waiting
        if pending.isEmpty():
            return done


def build(messages: DataFrame, **columns: str) -> Trie:
    """The trie of the rebuilt conversations: the first h turns of conversation c - c % 100, then c's own after its first h; h is the CRC-32 of c's decimal text, modulo 6.

    Nulls in role and text are empty, null turns come first, rows of one turn stand by role and text, repeated rows count each; % of a negative id
    is negative, as in SQL. Rows without an id take no part, other columns are ignored. An empty table has no nodes.
    """
    known, rows = rebuilt(*numbered(messages, **columns))
    nothing = F.lit(None).cast("long")
    rows = rows.unionByName(known.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in KEY), nothing.alias("q1"), nothing.alias("q2"), F.lit(0).cast("long").alias("chars")))
    rows = materialize(rows, "prefixes")
    owner = F.min(F.struct(F.xxhash64("conv_id"), F.col("conv_id")))["conv_id"]
    nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), owner.alias("owner"))
    nodes = materialize(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    nodes = _with_parents(nodes).withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    nodes = materialize(nodes, "nodes")
    tops = nodes.filter("parent_owner IS NULL OR parent_owner <> owner").select("owner", F.col("parent_owner").alias("above"), (F.col("depth") - 1).alias("at"))
    hung = tops.filter("above IS NOT NULL").groupBy(F.col("above").alias("owner")).agg(F.count("*").alias("remaining"))
    sums = nodes.groupBy("owner").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    units = tops.join(sums, "owner").join(hung, "owner", "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)))
    done = peeled(materialize(units, "units"))
    # inside a unit: what a node and all below it on its path have, with what came in from other units
    came = done.filter("above IS NOT NULL").groupBy(F.col("above").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    nodes = nodes.join(came, ["owner", "depth"], "left").withColumn("leaf", F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).withColumn("own", F.col("own") + F.coalesce("more_saved", F.lit(0)))
    nodes = nodes.drop("more_leaves", "more_saved").withColumn("stretch", F.floor(F.col("depth") / STRETCH))
    totals = nodes.groupBy("owner", "stretch").agg(F.sum("leaf").alias("l"), F.sum("own").alias("s"))
    below = Window.partitionBy("owner").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("owner", "stretch", F.coalesce(F.sum("l").over(below), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(below), F.lit(0)).alias("s"))
    inside = Window.partitionBy("owner", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.join(totals, ["owner", "stretch"]).select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", (F.sum("leaf").over(inside) + F.col("l")).alias("n_leaves"), (F.sum("own").over(inside) + F.col("s")).alias("saved_tokens"))
    return Trie(nodes, rows.join(known.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select(*KEY, "conv_id"))


def ends_digest(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """depth, p1, p2, ends_sha256: the SHA-256 of the node's ids, ascending and joined by commas.

    Ids are sorted in ranges; each range makes pieces of text, and a node's pieces are hashed in their order as a stream. A hash is sequential, so a node's text
    goes through one task in the end, a piece at a time.
    """
    order = [*KEY, "conv_id"]

    def pieces(batches):
        from pyspark import TaskContext

        part, k, node, ids = TaskContext.get().partitionId(), 0, None, []
        out = []
        for b in batches:
            for *key, i in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if key != node or len(ids) == piece:
                    if ids:
                        out.append((*node, part, k, ",".join(ids)))
                        k += 1
                    node, ids = key, []
                ids.append(str(i))
            yield _batch(out, ("depth", "p1", "p2", "part", "k", "text"))
            out = []
        if ids:
            yield _batch([(*node, part, k, ",".join(ids))], ("depth", "p1", "p2", "part", "k", "text"))

    def hashes(batches):
        node, digest = None, None
        for b in batches:
            out = []
            for *key, text in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 5)), strict=True):
                if key != node:
                    if digest is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield _batch(out, (*KEY, "ends_sha256"))
        if digest is not None:
            yield _batch([(*node, digest.hexdigest())], (*KEY, "ends_sha256"))

    made = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "depth long, p1 long, p2 long, part long, k long, text string")
    made = materialize(made, "pieces").repartition(*KEY).sortWithinPartitions(*KEY, "part", "k")
    return made.mapInArrow(hashes, "depth long, p1 long, p2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: tuple) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("text", "ends_sha256") else pa.int64() for n in names]
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(names))


def summary(messages: DataFrame, **columns: str) -> DataFrame:
    """The trie's nodes, one row each, with ends_sha256; see build()."""
    trie = build(messages, **columns)
    rows = trie.nodes.join(ends_digest(trie.ends), KEY, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
