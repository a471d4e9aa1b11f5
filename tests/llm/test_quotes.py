from lintlake.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, depth string, level int"


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r["conv_id"], r["turn"]): r.asDict() for r in quotes.conversations(frame).collect()}


def test_levels_and_passages():
    text = "On Monday, Ann wrote:\n> first line\n> goes on.\n>> older.\n\nmy answer\n> second"
    own, passages = quotes.parse(text)
    assert own == "my answer" and passages == [(1, "first line\ngoes on."), (2, "older."), (1, "second")]
    assert quotes.parse(None) == ("", []) and quotes.parse("") == ("", [])
    assert quotes.units("Hello,  WORLD.\nNext one!") == quotes.units("hello world. next\none")


def test_reply_tree(spark):
    rows = [
        (1, 0, "a", "Apples are red. Pears are green."),
        (1, 1, "b", "Plums are blue."),
        (1, 2, "c", "> Apples are\n> red.\nNot all of them."),
        (1, 3, "d", "> > Apples are red.\n> Not all of them.\nSome are."),
        (1, 4, "e", "no quote"),
        (1, 5, "f", "> nobody said this\nnew"),
        (2, 7, "a", "> Apples are red.\nother conversation"),
        (2, 9, "b", "gap"),
    ]
    got = run(spark, rows)
    links = {k: (v["parent_turn"], v["quoted"], v["root_turn"], v["depth"]) for k, v in got.items()}
    assert links == {(1, 0): (None, False, 0, 0), (1, 1): (0, False, 0, 1), (1, 2): (0, True, 0, 1), (1, 3): (2, True, 0, 2), (1, 4): (3, False, 0, 3), (1, 5): (4, False, 0, 4), (2, 7): (None, False, 7, 0), (2, 9): (7, False, 7, 1)}
    assert [k[1] for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["place"])] == list(range(6))
    assert got[1, 3]["text"] == "Some are."


def test_long_chain(spark):
    got = run(spark, [(1, k, "a", f"turn {k}") for k in range(70)])
    assert all(got[1, k]["depth"] == k and got[1, k]["root_turn"] == 0 for k in range(70))


def test_gaps_and_extreme_turns(spark):
    top, low = 2**63 - 1, -(2**63)
    got = run(spark, [(1, 1, "a", "One thing said."), (1, 3, "b", "three"), (1, 5, "a", "five"), (2, low, "a", "low"), (2, top, "b", "top"), (2, top - 1, "c", "below"), (3, top, "a", "alone")])
    links = {k: (v["parent_turn"], v["root_turn"], v["depth"], v["place"]) for k, v in got.items()}
    assert links == {(1, 1): (None, 1, 0, 0), (1, 3): (1, 1, 1, 1), (1, 5): (3, 1, 2, 2), (2, low): (None, low, 0, 0), (2, top - 1): (low, low, 1, 1), (2, top): (top - 1, low, 2, 2), (3, top): (None, top, 0, 0)}


def test_places_follow_the_replies(spark):
    rows = [(1, 2 * k, "a", f"Statement number {k} of this talk." if k < 4 else f"> Statement number {k % 4} of this talk.\nreply {k}") for k in range(40)]
    got = run(spark, rows)
    assert sorted(v["place"] for v in got.values()) == list(range(40))
    assert all(v["parent_turn"] is None or got[1, v["parent_turn"]]["place"] < v["place"] for v in got.values())


def test_stretches_over_many_ranges(spark):
    """Replies to random earlier messages, in stretches that go over the ends of ranges: depths by a walk."""
    import random

    draw, rows, expected = random.Random(5), [], {}
    for conv, size in ((1, 600), (2, 1), (3, 40)):
        depth = []
        for k in range(size):
            to = draw.randrange(k) if k and draw.random() < 0.3 else None
            rows.append((conv, 3 * k, "a", ("" if to is None else f"> Statement {to} stands.\n") + f"Statement {k} stands."))
            depth.append(0 if k == 0 else depth[k - 1 if to is None else to] + 1)
            expected[conv, 3 * k] = (None if k == 0 else 3 * (k - 1 if to is None else to), to is not None, 0, depth[k], k)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: (v["parent_turn"], v["quoted"], v["root_turn"], v["depth"], v["place"]) for k, v in got.items()} == expected


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "a", ""), (None, 3, "a", "> x\ny"), (1, None, "a", "z"), (1, 1, "b", "same"), (1, 1, "b", "same")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = quotes.conversations(frame).collect()
    assert len(out) == 6 and sorted(r["depth"] for r in out) == [0, 0, 0, 0, 1, 1]
    assert quotes.conversations(frame.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark, sf):
    """Every message of the table: links, roots and depths by dictionaries, message by message."""
    from collections import Counter, defaultdict

    from lintlake.llm.common import table

    rows = table(spark, sf, "conversations").collect()
    talks = defaultdict(dict)
    for r in rows:
        talks[r["conv_id"]].setdefault(r["turn"], quotes.parse(r["text"]))
    expected = {}
    for conv, turns in talks.items():
        first = {}
        for t in sorted(turns):
            for h, _ in quotes.units(turns[t][0]):
                first.setdefault(h, t)
        for t in sorted(turns):
            words = defaultdict(Counter)
            for level, passage in turns[t][1]:
                for h, n in quotes.units(passage):
                    if first.get(h, t) < t:
                        words[level][first[h]] += n
            best = {level: max((n, s) for s, n in c.items()) for level, c in words.items()}
            if best:
                parent, quoted = best[min(best)][1], True
            else:
                parent, quoted = max((x for x in turns if x < t), default=None), False
            _, _, root, depth = expected.get((conv, parent), (None, None, t, -1)) if parent is not None else (None, None, t, -1)
            expected[conv, t] = (parent, quoted, root, depth + 1)
    got = quotes.conversations(table(spark, sf, "conversations")).collect()
    assert len(got) == len(rows) and any(r["quoted"] for r in got) or not any(e[1] for e in expected.values())
    assert all((r["parent_turn"], r["quoted"], r["root_turn"], r["depth"]) == expected[r["conv_id"], r["turn"]] and r["text"] == talks[r["conv_id"]][r["turn"]][0] for r in got if list(talks[r["conv_id"]]).count(r["turn"]) == 1)
