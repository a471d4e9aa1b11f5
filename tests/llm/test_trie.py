"""The prefix trie against a plain recursive build, over odd rows and deep, branching and repeated conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lintlake.llm import trie


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        under = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in under) if under else 1
        saved[node] = ((len(members[node]) - 1) * len(node[-1][1]) if node else 0) + sum(saved[x] for x in under)
    out = []
    for node, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if rebuilt[c] == node)))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("owner", F.lit(1)).repartition(parts)
    got = sorted(map(tuple, trie.summary(frame).collect()), key=str)
    assert got == brute(rows)
    return got


def test_branching_and_repeated_conversations(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(0, 260), 1100, 1101, 1150, -5, -205, -200, 2**62, 5031]:
        words = r.choice(["ab", "abc", "a"])
        rows += [(c, t if r.random() < 0.9 else None, r.choice(["user", "user", None]), r.choice(words) * (t + 1)) for t in range(r.choice([0, 1, 1, 2, 4, 7, 9]))]
    rows += [(300 + k, t, "user", f"turn {t}") for k in range(60) for t in range(8)]  # a third of all rows the same
    rows += [(None, 1, "user", "no id"), (1, 1, "user", "twice"), (1, 1, "user", "twice"), (7, 0, None, None), (7, 0, "", "é🙂")]
    check(spark, rows)


def test_long_conversations_and_a_staircase(spark):
    same = [(500, t, "user", f"long {t}") for t in range(3000)] + [(400, t, "user", f"long {t}") for t in range(2990)]
    stairs = [(600 + k, t, "u", f"s{t}") for k in range(40) for t in range(k)]  # each one turn longer than the one before
    check(spark, same + stairs, parts=4)


@pytest.mark.parametrize("rows", [[], [(None, 0, "a", "b")], [(1, None, None, None)], [(100, 0, "a", "b"), (101, 0, "a", "b")]])
def test_tiny_tables(spark, rows):
    check(spark, rows, parts=1)


def test_ids_of_one_node_are_hashed_in_order_whatever_the_pieces(spark):
    ends = spark.range(3000).select(F.lit(2).cast("long").alias("depth"), F.lit(1).cast("long").alias("p1"), F.lit(1).cast("long").alias("p2"), (F.lit(2999) - F.col("id")).alias("conv_id"))
    for piece in (7, 512):
        assert [r["ends_sha256"] for r in trie.ends_digest(ends.repartition(5), piece).collect()] == [hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()]
