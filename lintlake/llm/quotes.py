"""Replies linked to what they quote, and conversations in reply order without the quotes.

Each line's quote level is the number of its leading `>` marks. Sentences of quoted passages, normalised and hashed, are joined to
the messages of the conversation that said them first in their own words; a reply's parent is the message of its least quote level with
the most quoted words. A message without a link continues the one before it, however far its turn lies back, so a conversation has one root, its first message, and falls into
stretches that a quoting message begins. Depths come from pointer doubling over the beginnings of stretches alone; the rest counts on from its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import carried, materialize, placed, string_col

MARK = re.compile(r"\s{0,3}>[ \t]?")
# Fixed forms of the line that introduces a quote.
INTRODUCTION = re.compile(r"(?i)^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió|\S.{0,80}\b(?:wrote|writes|said))\s*:\s*$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def level(line: str) -> tuple[int, str]:
    """Quote level and the rest of a line."""
    n, at = 0, 0
    while m := MARK.match(line, at):
        n, at = n + 1, m.end()
    return n, line[at:]


def units(text: str) -> list[tuple[int, int]]:
    """Hash and words of each sentence, normalised: lower-cased words without punctuation. Line breaks don't matter."""
    out = []
    for s in SENTENCE.split(" ".join(text.split())):
        words = re.findall(r"\w+", s.lower())
        if words:
            out.append((xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")), len(words)))
    return out


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and its quoted passages (level, text) in order; nested levels are passages of their own."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").split("\n"):
        n, rest = level(line)
        if n == 0:
            own.append(line)
        else:
            if before == 0:
                while own and not own[-1].strip():
                    own.pop()
                if own and INTRODUCTION.match(own[-1]):
                    own.pop()
            if passages and passages[-1][0] == n and before == n:
                passages[-1][1].append(rest)
            else:
                passages.append((n, [rest]))
            if INTRODUCTION.match(rest):
                passages[-1][1].pop()
        before = n
    return "\n".join(own).strip(), [(n, "\n".join(x)) for n, x in passages]


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text (own), said (own hashes), quoted (level, hash, words)."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))

    def run(batches):
        for b in batches:
            own, said, quoted = [], [], []
            for t in b.column(3).to_pylist():
                text, passages = parse(t)
                own.append(text)
                said.append(np.array([h for h, _ in units(text)], np.uint64).view(np.int64))
                quoted.append([{"level": n, "hash": int(np.uint64(h).view(np.int64)), "words": w} for n, x in passages for h, w in units(x)])
            cols = [pa.array(own), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["conv_id", "turn", "role", "text", "said", "quoted"])

    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), string_col(messages, text_col).alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, said array<long>, quoted array<struct<level: int, hash: long, words: int>>")


def quote_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, source_turn, words: for each quote level of a message, the earlier message that most of its words come from."""
    first = rows.select("conv_id", F.explode("said").alias("hash"), "turn").groupBy("conv_id", "hash").agg(F.min("turn").alias("source_turn"))
    quoted = rows.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.words")
    met = quoted.join(first, ["conv_id", "hash"]).filter(F.col("source_turn") < F.col("turn"))
    summed = met.groupBy("conv_id", "turn", "level", "source_turn").agg(F.sum("words").alias("words"))
    best = F.max(F.struct("words", "source_turn")).alias("best")
    return summed.groupBy("conv_id", "turn", "level").agg(best).select("conv_id", "turn", "level", "best.source_turn", "best.words")


def _depths(nodes: DataFrame) -> DataFrame:
    """conv_id, place, depth of each message that quotes; nodes: conv_id, turn, place, quoted_turn and head, the place where the message's stretch begins.

    A pointer leads from the beginning of a stretch to that of the stretch which holds the quoted message, as many replies higher as hops says. Pointers to a
    conversation's first message (place 0) are done with, so no root stands in a join.
    """
    held = nodes.select("conv_id", F.col("turn").alias("quoted_turn"), F.col("head").alias("next"), (F.col("place") - F.col("head") + 1).alias("hops"))
    links = materialize(nodes.filter("quoted_turn IS NOT NULL").select("conv_id", "place", "quoted_turn").join(held, ["conv_id", "quoted_turn"]).drop("quoted_turn"), "pointers")
    done, pending = [links.filter("next = 0")], links.filter("next > 0")
    while not pending.isEmpty():
        up = pending
        for d in done:
            up = up.unionByName(d)
        up = up.select("conv_id", F.col("place").alias("next"), F.col("next").alias("further"), F.col("hops").alias("more"))
        moved = pending.join(up, ["conv_id", "next"]).select("conv_id", "place", F.col("further").alias("next"), (F.col("hops") + F.col("more")).alias("hops"))
        moved = materialize(moved, "pointers")
        done.append(moved.filter("next = 0"))
        pending = moved.filter("next > 0")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.select("conv_id", "place", F.col("hops").alias("depth"))


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text without quotes, parent_turn, quoted (whether the parent was found by a quote), root_turn, depth, place.

    place: from 0, inside the conversation, by turn, so every reply comes after its parent; repeated rows share theirs. Turns may be any numbers, with gaps. Messages
    without conv_id or turn stay, alone and without a place;
    repeated (conv_id, turn) rows are all kept and share their links. Null and empty texts have an empty text. Passages that nobody said before link to nothing; other columns are ignored.
    """
    rows = materialize(parsed(messages, conv_col, turn_col, role_col, text_col), "messages")
    keyed = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    # a quote of level 1 names the parent, a deeper one an older message
    parents = quote_links(keyed).groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("words"), F.col("source_turn").alias("source_turn"))).alias("best"))
    parents = parents.select("conv_id", "turn", F.col("best.source_turn").alias("quoted_turn"))
    nodes = placed(keyed.select("conv_id", "turn").distinct().join(parents, ["conv_id", "turn"], "left"), "conv_id", ["turn"], keep_part=True)
    begins = F.col("quoted_turn").isNotNull() | (F.col("place") == 0)
    nodes = nodes.withColumn("begin", F.when(begins, F.col("place"))).withColumn("first_turn", F.when(F.col("place") == 0, F.col("turn")))
    nodes = carried(nodes, "conv_id", {"head": ("begin", True), "last_turn": ("turn", False), "root_turn": ("first_turn", True)})
    nodes = materialize(nodes.drop("begin", "first_turn"), "nodes")
    depths = _depths(nodes)
    filled = nodes.join(depths, ["conv_id", "place"], "left").withColumn("begun", F.when(F.col("place") == 0, 0).otherwise(F.col("depth") - F.col("place"))).drop("depth")
    filled = carried(filled, "conv_id", {"shift": ("begun", True)})
    nodes = filled.select("conv_id", "turn", F.coalesce("quoted_turn", "last_turn").alias("parent_turn"), F.col("quoted_turn").isNotNull().alias("quoted"), "root_turn", (F.col("place") + F.col("shift")).alias("depth"), "place")
    linked = keyed.select("conv_id", "turn", "role", "text").join(nodes, ["conv_id", "turn"])
    alone = rows.filter("conv_id IS NULL OR turn IS NULL").select("conv_id", "turn", "role", "text", F.lit(None).cast("long").alias("parent_turn"), F.lit(False).alias("quoted"), F.col("turn").alias("root_turn"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("place"))
    return linked.unionByName(alone)
