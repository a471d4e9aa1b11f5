"""The event sweep against a plain loop over both tokenizers' tokens, whatever the sizes of runs, steps and blocks."""

import hashlib
import json
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lintlake.llm import alignment
from lintlake.llm.common import table

ODD = ["", None, "one", "one", "▁mark", "a ▁ b", "<|endoftext|> and <s> </s> <unk> <0x41>", "nul \0 here", "é ü 漢字 🙂🙂 Ⅷ", "tab\there\n\n\nnew  two   three", " " * 3000 + "x", "abc" * 2000, " leading", "trailing ", "12345 67,8.9!?", "▁", "\r\n", "x y​z", "İıſ"]


def brute(rows):
    """The result's rows by one loop a document, with the plain encoders."""
    t = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.BYTE_LEVEL}")
    t.encode_special_tokens = True
    chars = alignment._byte_chars()
    a_bytes = {n: bytes(chars[c] for c in p) for p, n in json.loads(Path(alignment.TOKENIZERS, alignment.BYTE_LEVEL).read_text())["model"]["vocab"].items() if p != "<|endoftext|>"}
    m = SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.PIECES}")
    b_bytes = [bytes([int(m.id_to_piece(n)[3:5], 16)]) if m.is_byte(n) else m.id_to_piece(n).replace("▁", " ").encode() for n in range(m.vocab_size())]
    told, holders = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
            said = (" " + text).encode()
            if b"".join(a_bytes[x] for x in a) == said == b"".join(b_bytes[x] for x in b):
                ends_a, ends_b = np.cumsum([len(a_bytes[x]) for x in a]).tolist(), np.cumsum([len(b_bytes[x]) for x in b]).tolist()
                both = sorted(set(ends_a) & set(ends_b))
                i = j = 0
                for end in both:
                    x, y = [], []
                    while i < len(a) and ends_a[i] <= end:
                        x.append(a[i])
                        i += 1
                    while j < len(b) and ends_b[j] <= end:
                        y.append(b[j])
                        j += 1
                    groups.append((x, y))
        linked = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holders.update(linked.keys())
        told.append((doc, groups, linked))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for doc, groups, linked in told:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()), sum(n for p, n in linked.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in linked.items()), digest))
    return sorted(out, key=str)


def test_alignment_by_brute_force(spark, sf):
    rows = [(k if k != 3 else 2, t) for k, t in enumerate(ODD)] + [(None, "no id")]
    rows += [(1000 + r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    expected = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("block", F.lit("x")).repartition(3)
    for options in ({}, {"step": 40, "tokens": 7, "block": 500}, {"step": 1, "tokens": 1000}):
        assert sorted(map(tuple, alignment.summary(frame, **options).collect()), key=str) == expected
    assert sum(r[1] > 0 for r in expected) > 150 and [r for r in expected if r[0] == 4][0][1:7] == (0,) * 6
    assert alignment.summary(frame.limit(0)).count() == 0


def test_groups_cover_the_texts(spark):
    rows = [(k, t) for k, t in enumerate(ODD)]
    for step in (1 << 18, 5):
        got = alignment.groups(spark.createDataFrame(rows, "doc_id long, text string"), step=step, tokens=4).collect()
        by_doc = defaultdict(list)
        for r in sorted(got, key=lambda r: (r["doc_id"], r["place"])):
            by_doc[r["doc_id"]].append(r)
        for doc, found in by_doc.items():
            assert [r["place"] for r in found] == list(range(len(found)))
            assert found[0]["start"] == 0 and found[-1]["end"] == len((" " + ODD[doc]).encode())
            assert all(x["end"] == y["start"] for x, y in zip(found, found[1:], strict=False))
            assert all(r["a_ids"] and r["b_ids"] for r in found)


def test_a_group_of_many_tokens_is_counted_by_distinct_ids():
    g = alignment.Groups([(0, 0)], np.array([0, 0]), np.array([5] * 400 + [6, 5]), np.array([1, 2] * 200 + [1, 2]), np.array([401, 1]), np.array([400, 2]), np.array([9, 10]), 1)
    docs, codes, counts = g.links(10)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {51: 80001, 52: 80001, 61: 200, 62: 200} and set(docs.tolist()) == {0}


def test_both_encoders_of_the_byte_level_file_agree(spark, sf):
    first, _ = alignment._pair(alignment.Tokenizers().files)
    texts = [" " + r["text"] for r in table(spark, sf, "documents").select("text").collect()] + [" " + t for t in ODD if t] + [" " + "a" * 50_000, " " + " " * 50_000]
    assert first.ranked is not None
    for text, ids in zip(texts, first.encode(texts), strict=True):
        assert ids.tolist() == first.plain.encode(text, add_special_tokens=False).ids
