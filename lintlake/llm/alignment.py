"""Tokens of two tokenizers aligned by an event sweep.

Every text becomes runs of end events: which tokenizer (side), the byte where the run begins and its token ids; a token's end is the run's beginning
plus the byte lengths of the tokens up to it. The runs of both sides are dealt out by document and sorted by offset inside the partitions, and a
machine reads each partition as a stream. It holds the open group, one run a side and the document's counters, cuts where both sides
end and gives out groups and links. Tokens of one group are linked, all of A with all of B.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import materialize

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Tokens of a run, tokens that the machine takes at once, products of a group's sides above which it is counted by distinct ids, links of a block.
RUN, STEP, WIDE, BLOCK = 4096, 1 << 18, 1 << 16, 1 << 21
# Fixed value: the pattern by which the byte-level tokenizer cuts words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space for which the pattern's engine runs out of room.
SPACES = re.compile(r"\s{1000}")
A, B, NONE = 0, 1, 2


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE of a tokenizers file: ids of texts, and the bytes of each id.

    Where the merges stand in the order of their ids, an encoder by ranks gives the same ids in a quarter of the time and is used instead.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        spec, chars = json.loads(content), _byte_chars()
        vocabulary = spec["model"]["vocab"]
        self.plain = Tokenizer.from_str(content.decode("utf-8"))
        self.plain.encode_special_tokens = True
        self.plain.no_padding()
        self.plain.no_truncation()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.pieces = [b""] * (1 + max((*vocabulary.values(), *special.values())))
        for text, n in vocabulary.items():
            self.pieces[n] = text.encode("utf-8") if text in special else bytes(chars[c] for c in text)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        before = spec.get("pre_tokenizer") or {}
        ranked = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec.get("normalizer") is None and all(vocabulary.get("".join(m)) == 256 + k for k, m in enumerate(merges))
        self.ranked = None
        if ranked:
            import tiktoken

            ranks = {self.pieces[n]: n for text, n in vocabulary.items() if text not in special}
            self.ranked = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            if self.ranked is not None and not SPACES.search(text):
                yield self.ranked.encode_to_numpy(text, disallowed_special=())
            else:
                yield np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of each id."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(n) else p.replace("▁", " ").encode("utf-8") for n, p in ((n, self.model.id_to_piece(n)) for n in range(self.model.vocab_size()))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for ids in self.model.encode(texts, num_threads=1):
            yield np.array(ids, np.uint32)


_loaded: dict[bytes, tuple] = {}


def _pair(files: tuple[bytes, bytes]):
    """The two tokenizers of these files, loaded once a worker."""
    key = hashlib.sha256(files[0]).digest() + hashlib.sha256(files[1]).digest()
    if key not in _loaded:
        _loaded[key] = (ByteLevel(files[0]), Pieces(files[1]))
    return _loaded[key]


class Tokenizers:
    """The contents of the two files and the byte lengths of their tokens. Both are read on the driver and sent out: a vocabulary's size bounds them."""

    def __init__(self, folder: str = TOKENIZERS, byte_level: str = BYTE_LEVEL, pieces: str = PIECES):
        self.files = (Path(folder, byte_level).read_bytes(), Path(folder, pieces).read_bytes())
        both = _pair(self.files)
        self.lengths = tuple(np.array([len(p) for p in t.pieces], np.int64) for t in both)
        self.sizes = tuple(len(t.pieces) for t in both)
        self.code = pa.int32() if self.sizes[0] * self.sizes[1] < 2**31 else pa.int64()


RUNS = "row long, doc_id long, side byte, at long, ids binary"


def runs(docs: DataFrame, tokenizers: Tokenizers, id_col: str = "doc_id", text_col: str = "text", batch: int = 64, tokens: int = RUN) -> DataFrame:
    """row (a number for each document), doc_id, side, at, ids: the end events of both tokenizers, in runs. Documents without tokens have one row of side 2."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizers.files)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        first, second = _pair(sent.value)
        sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in (first, second)]
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part, out = whole.slice(at, batch), []
                texts = part.column(2).to_pylist()
                held = [t for t in texts if t]
                made = zip(held, first.encode([" " + t for t in held]), second.encode(held), strict=True)
                for row, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    ids = ()
                    if text:
                        t, a, b = next(made)
                        said = (" " + t).encode("utf-8")
                        if all(b"".join([k.pieces[i] for i in x.tolist()]) == said for k, x in ((first, a), (second, b))):
                            ids = (a, b)
                    if not ids:
                        out.append((row, doc, NONE, 0, b""))
                    for side, x in enumerate(ids):
                        starts = np.cumsum(sizes[side][x]) - sizes[side][x]
                        for i in range(0, len(x), tokens):
                            out.append((row, doc, side, int(starts[i]), x[i : i + tokens].astype("<u4" if len(sizes[side]) > 65536 else "<u2").tobytes()))
                kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RUNS.split(", ")])

    return rows.mapInArrow(run, RUNS)


class Groups:
    """What the machine found in a stretch of events: whole groups of whole documents, but for the first and the last document.

    doc: the document of each group, as a place in rows; a, b: ids; n_a, n_b: how many of them each group has; end: its last byte's offset plus one.
    """

    def __init__(self, rows, doc, a, b, n_a, n_b, end, finished):
        self.rows, self.doc, self.a, self.b, self.n_a, self.n_b, self.end, self.finished = rows, doc, a, b, n_a, n_b, end, finished

    def links(self, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, code (a * other + b) and number of each distinct pair of ids that a document holds linked, in order."""
        wide = np.flatnonzero(self.n_a * self.n_b > WIDE)
        narrow = np.ones(len(self.doc), bool)
        narrow[wide] = False
        first_a, first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        group = np.repeat(np.arange(len(self.doc)), self.n_a)
        taken = narrow[group]
        group, a = group[taken], self.a[taken]
        many = self.n_b[group]
        at = np.repeat(first_b[group] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        docs, codes, counts = [np.repeat(self.doc[group], many)], [np.repeat(a, many) * other + self.b[at]], [None]
        for g in wide:
            x, n = np.unique(self.a[first_a[g] : first_a[g] + self.n_a[g]], return_counts=True)
            y, m = np.unique(self.b[first_b[g] : first_b[g] + self.n_b[g]], return_counts=True)
            docs.append(np.full(len(x) * len(y), self.doc[g]))
            codes.append((x[:, None] * other + y).ravel())
            counts.append((n[:, None] * m).ravel())
        span = np.int64(max((int(c.max()) for c in codes if len(c)), default=0) + 1)
        keys, n = np.unique(docs[0] * span + codes[0], return_counts=True)
        if len(wide):
            keys, n = _summed([keys, *(d * span + c for d, c in zip(docs[1:], codes[1:], strict=True))], [n, *counts[1:]])
        return keys // span, keys % span, n


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate(counts))
    return keys, n


class Machine:
    """Reads runs sorted by document, offset and side, and gives out Groups. Between two calls it holds the open group and what came after the last sure cut."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths, self.held, self.size = lengths, [], 0

    def add(self, row: int, doc: int | None, side: int, at: int, ids: bytes) -> None:
        x = np.frombuffer(ids, "<u4" if side < NONE and len(self.lengths[side]) > 65536 else "<u2").astype(np.int64)
        self.held.append((row, doc, side, at, x))
        self.size += len(x)

    def groups(self, last: bool) -> Groups | None:
        """The groups of what was added, as far as no later run can change them; last: nothing comes any more."""
        held, self.held, self.size = self.held, [], 0
        if not held:
            return None
        rows, place, sides = [], {}, ([], [])
        for row, doc, side, at, x in held:
            if row not in place:
                place[row] = len(rows)
                rows.append((row, doc))
            if side != NONE:
                sides[side].append((place[row], at, x))
        docs, keys, ids = [], [], []
        for side, blocks in enumerate(sides):
            x = np.concatenate([b[2] for b in blocks]) if blocks else np.zeros(0, np.int64)
            n = np.array([len(b[2]) for b in blocks], np.int64)
            size = self.lengths[side][x]
            run = np.append(0, np.cumsum(size))
            start = np.array([b[1] for b in blocks], np.int64) - run[np.cumsum(n) - n]
            docs.append(np.repeat(np.array([b[0] for b in blocks], np.int64), n))
            keys.append(run[1:] + np.repeat(start, n))
            ids.append(x)
        longest = np.zeros(len(rows), np.int64)
        for side in (A, B):
            np.maximum.at(longest, docs[side], keys[side])
        base = np.cumsum(longest + 1) - (longest + 1)
        at = [keys[side] + base[docs[side]] for side in (A, B)]
        met = np.searchsorted(at[B], at[A])
        cut_a = met < len(at[B])
        cut_a[cut_a] = at[B][met[cut_a]] == at[A][cut_a]
        if not last:  # in the last document, later runs begin where the last one begins or after it
            cut_a &= (docs[A] < len(rows) - 1) | (keys[A] <= held[-1][3])
        cut_b = np.zeros(len(at[B]), bool)
        cut_b[met[cut_a]] = True
        in_a, in_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b  # the group of each token
        n = int(cut_a.sum())
        closed = (in_a < n, in_b < n)
        if not last:
            row, doc = rows[-1]
            for side in (A, B):
                left = np.flatnonzero(~closed[side])
                if len(left) or not cut_a.any():
                    first = int(keys[side][left[0]] - self.lengths[side][ids[side][left[0]]]) if len(left) else int(held[-1][3])
                    self.held.append((row, doc, side, first, ids[side][left]))
                    self.size += len(left)
            if not self.held:  # the document may go on
                self.held.append((row, doc, A, int(longest[-1]), np.zeros(0, np.int64)))
        ends = np.flatnonzero(cut_a)
        return Groups(rows, docs[A][ends], ids[A][closed[A]], ids[B][closed[B]], np.bincount(in_a[closed[A]], minlength=n), np.bincount(in_b[closed[B]], minlength=n), keys[A][ends], len(rows) if last else len(rows) - 1)


def _stretches(batches, lengths, step: int = STEP) -> Iterator[Groups]:
    machine, enough = Machine(lengths), step
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if machine.size >= enough:
                yield machine.groups(False)
                enough = max(step, 2 * machine.size)  # a group that stays open isn't looked through for every run
            machine.add(*row)
    found = machine.groups(True)
    if found is not None:
        yield found


def swept(events: DataFrame) -> DataFrame:
    """The runs dealt out by document, those of a document in the order of their offsets."""
    return events.repartition("row").sortWithinPartitions("row", "at", "side")


def groups(docs: DataFrame, tokenizers: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text", step: int = STEP, tokens: int = RUN) -> DataFrame:
    """row, doc_id, place (from 0), start, end (bytes of space+text), a_ids, b_ids: one row for each group, for whoever wants the alignment itself.

    row tells documents of one id apart. Texts without tokens (see links()) have no groups.
    """
    tokenizers = tokenizers or Tokenizers()
    lengths = tokenizers.lengths

    def run(batches):
        row, place, start = None, 0, 0
        for g in _stretches(batches, lengths, step):
            out = []
            ia, ib = np.cumsum(g.n_a), np.cumsum(g.n_b)
            for k in range(len(g.doc)):
                r, doc = g.rows[g.doc[k]]
                place, start = (place, start) if r == row else (0, 0)
                row = r
                out.append((r, doc, place, start, int(g.end[k]), g.a[ia[k] - g.n_a[k] : ia[k]].tolist(), g.b[ib[k] - g.n_b[k] : ib[k]].tolist()))
                place, start = place + 1, int(g.end[k])
            if out:
                kinds = (*[pa.int64()] * 5, pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "doc_id", "place", "start", "end", "a_ids", "b_ids"])

    return swept(runs(docs, tokenizers, id_col, text_col, tokens=tokens)).mapInArrow(run, "row long, doc_id long, place long, start long, end long, a_ids array<int>, b_ids array<int>")


class _Tally:
    """Numbers, digest and links of one document while its groups come in."""

    def __init__(self, row, doc):
        self.row, self.doc, self.n_a, self.n_b, self.n_groups, self.n_links, self.hash, self.codes, self.counts = row, doc, 0, 0, 0, 0, None, [], []

    def text(self, part: bytes) -> None:
        """A part of the groups' text, which ends in a semicolon; the document's last one isn't hashed."""
        if part:
            self.hash, part = (hashlib.sha256(), part) if self.hash is None else (self.hash, b";" + part)
            self.hash.update(part[:-1])

    def finished(self) -> tuple:
        if len(self.codes) == 1:
            codes, counts = self.codes[0], self.counts[0]
        elif self.codes:
            codes, counts = _summed(self.codes, self.counts)
        else:
            codes = counts = np.zeros(0, np.int64)
        return (self.row, self.doc, self.n_a, self.n_b, self.n_groups, self.n_links, self.hash.hexdigest() if self.hash else "", codes, counts)


LINKED = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "counts", "block")


def links(docs: DataFrame, tokenizers: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text", step: int = STEP, block: int = BLOCK, tokens: int = RUN) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs: codes (a * size of B's vocabulary + b, in order) and counts.

    Texts null or empty, or whose tokens' bytes aren't those of space+text, have no tokens: zeros and empty values. Repeated rows are documents of
    their own, ids may be null, other columns are ignored, an empty table gives an empty one. Texts may be of any length. block numbers stretches of documents of some two million links.
    """
    tokenizers = tokenizers or Tokenizers()
    lengths, other, code = tokenizers.lengths, tokenizers.sizes[1], tokenizers.code
    texts = [np.array([f"{i}{mark}".encode() for i in range(n)], f"S{len(str(n)) + 1}") for n in (max(tokenizers.sizes),) for mark in (",", "|", ";")]
    table = np.concatenate(texts)
    wide = max(tokenizers.sizes)

    def said(g: Groups) -> tuple[np.ndarray, np.ndarray]:
        """The groups as text, a fixed width an id, and how many ids stand before each group."""
        n_ids = g.n_a + g.n_b
        before = np.cumsum(n_ids) - n_ids
        out = np.empty(int(n_ids.sum()), table.dtype)
        for ids, n, start, mark in ((g.a, g.n_a, before, 1), (g.b, g.n_b, before + g.n_a, 2)):
            which = np.zeros(len(ids), np.int64)
            which[np.cumsum(n) - 1] = mark
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(ids))
            out[at] = table[which * wide + ids]
        return out, np.append(before, len(out))

    def run(batches):
        from pyspark import TaskContext

        blocks, filled = TaskContext.get().partitionId() << 32, 0
        tally, done = None, []

        def batch():
            cols = list(zip(*done, strict=True))
            flat = [pa.array(c, k) for c, k in zip(cols[:7], (*[pa.int64()] * 6, pa.string()), strict=True)]
            at = np.concatenate([[0], np.cumsum([len(c) for c in cols[7]])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(c), k)) for c, k in zip(cols[7:9], (code, pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([*flat, *lists, pa.array(cols[9], pa.int64())], list(LINKED))

        for g in _stretches(batches, lengths, step):
            out, before = said(g)
            first = np.searchsorted(g.doc, np.arange(len(g.rows) + 1))  # each document's first group
            in_doc, codes, counts = g.links(other)
            own = np.searchsorted(in_doc, np.arange(len(g.rows) + 1))
            ca, cb, cl = (np.append(0, np.cumsum(x)) for x in (g.n_a, g.n_b, g.n_a * g.n_b))
            for k, (row, doc) in enumerate(g.rows):
                if tally is None or tally.row != row:
                    tally = _Tally(row, doc)
                lo, hi = int(first[k]), int(first[k + 1])
                if hi > lo:
                    tally.n_a += int(ca[hi] - ca[lo])
                    tally.n_b += int(cb[hi] - cb[lo])
                    tally.n_links += int(cl[hi] - cl[lo])
                    tally.n_groups += hi - lo
                    tally.text(out[before[lo] : before[hi]].tobytes().replace(b"\0", b""))
                    tally.codes.append(codes[own[k] : own[k + 1]])
                    tally.counts.append(counts[own[k] : own[k + 1]])
                if k < g.finished:
                    made = tally.finished()
                    tally = None
                    done.append((*made, blocks))
                    filled += len(made[7]) + 16
                    if filled > block:
                        blocks, filled = blocks + 1, 0
            if done:
                yield batch()
                done = []

    kind = "int" if code == pa.int32() else "long"
    schema = f"row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<{kind}>, counts array<long>, block long"
    return swept(runs(docs, tokenizers, id_col, text_col, tokens=tokens)).mapInArrow(run, schema)


def pair_counts(linked: DataFrame, other: int) -> tuple[DataFrame, DataFrame]:
    """block, code of all pairs that a block's documents hold linked, and code, a, b, n_docs, best: how many documents hold a pair, and whether no pair of its a is in more."""
    per_block = materialize(linked.select("block", F.explode("codes").alias("code")).groupBy("block", "code").agg(F.count("*").alias("n")), "pairs")
    total = per_block.groupBy("code").agg(F.sum("n").alias("n_docs"))
    total = total.select("code", F.floor(F.col("code") / other).cast("long").alias("a"), F.pmod("code", F.lit(other)).cast("long").alias("b"), "n_docs")
    highest = total.groupBy("a").agg(F.max("n_docs").alias("highest"))
    counted = total.join(highest, "a").select("code", "a", "b", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))
    return per_block, counted


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summary(docs: DataFrame, tokenizers: Tokenizers | None = None, **options) -> DataFrame:
    """Each document's numbers, with n_best and count_sum by the counts of id pairs over all documents; options and odd rows as in links().

    A block's distinct pairs meet the counts, and come back to the block: a pair that stands in every document stands once a block in the join.
    """
    tokenizers = tokenizers or Tokenizers()
    other = tokenizers.sizes[1]
    linked = materialize(links(docs, tokenizers, **options), "linked")
    per_block, counted = pair_counts(linked, other)
    known = per_block.select("block", "code").join(counted.select("code", "n_docs", "best"), "code")
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        codes = pairs["code"].to_numpy()
        order = np.argsort(codes)
        codes, n_docs, best = codes[order], pairs["n_docs"].to_numpy()[order], pairs["best"].to_numpy()[order]
        held, n = (docs[c].combine_chunks() for c in ("codes", "counts"))
        ends = np.append(0, np.cumsum(held.value_lengths().to_numpy()))  # where each document's links end
        at, n = np.searchsorted(codes, held.flatten().to_numpy()), n.flatten().to_numpy()
        total = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x))[ends]), pa.int64())
        sums = {"n_best": total(n * best[at]), "count_sum": total(n * n_docs[at])}
        return pa.table([sums[c] if c in sums else docs[c] for c in names], names)

    return linked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, RESULT)

