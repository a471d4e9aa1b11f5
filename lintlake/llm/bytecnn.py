"""Document quality by a byte-level convolutional network, trained and run in numpy.

Bytes are embedded, and learned filters slide over overlapping chunks that together cover the whole document. Each filter is
max-pooled over a chunk; a document's features are the greatest and the mean pooled value over its chunks, and a small dense
layer combines them into one probability.

The network is fitted on a bounded sample of labelled rows (`max_rows` of least hash, `max_bytes` in all); scores cover every
row and every byte. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm.common import string_col

CHUNK, WIDTH, STRIDE = 256, 8, 2
EMBED, FILTERS, HIDDEN = 8, 24, 12
#: Every window of WIDTH bytes that starts at a multiple of STRIDE lies in one chunk.
STEP = CHUNK - WIDTH + STRIDE
MAX_ROWS, MAX_BYTES = 2500, 24 << 20


def chunks(text: str | None) -> np.ndarray:
    """The whole text's UTF-8 bytes as rows of CHUNK bytes, zero-padded; an empty or null text is one row of zeros."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(raw) - WIDTH + STRIDE) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class ByteCNN:
    """Weights are small arrays, so that a fitted network travels in a task's closure."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.w = {
            "embed": draw(256, EMBED, scale=0.5),
            "conv": draw(WIDTH * EMBED, FILTERS, scale=(2 / (WIDTH * EMBED)) ** 0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": draw(2 * FILTERS, HIDDEN, scale=(1 / FILTERS) ** 0.5),
            "dense_bias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def convolve(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, positions, filters) before pooling."""
        m, blocks = len(rows), CHUNK // STRIDE
        x = self.w["embed"][rows].reshape(m, blocks, STRIDE * EMBED)
        k = self.w["conv"].reshape(WIDTH // STRIDE, STRIDE * EMBED, FILTERS)
        places = blocks - len(k) + 1
        out = np.matmul(x[:, :places], k[0])
        for i in range(1, len(k)):
            out += np.matmul(x[:, i : i + places], k[i])
        return out

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """(chunks, filters): each filter's greatest response in each chunk."""
        parts = [self.convolve(rows[i : i + 64]).max(axis=1) for i in range(0, len(rows), 64)]
        return np.maximum(np.concatenate(parts) + self.w["bias"], 0)

    def combine(self, pooled: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document features, hidden values and probabilities; starts: each document's first chunk."""
        sizes = np.diff(np.append(starts, len(pooled)))[:, None]
        feats = np.concatenate([np.maximum.reduceat(pooled, starts), np.add.reduceat(pooled, starts) / sizes], axis=1)
        hidden = np.tanh(feats @ self.w["dense"] + self.w["dense_bias"])
        z = np.clip(hidden @ self.w["out"] + self.w["out_bias"], -30, 30)
        return feats, hidden, 1 / (1 + np.exp(-z))

    def scores(self, texts: list) -> np.ndarray:
        """One probability a text."""
        pieces, at, total = [], [], 0
        for t in texts:
            rows = chunks(t)
            at.append(total)
            total += len(rows)
            pieces.append(rows)
        pooled, i = [], 0
        while i < len(pieces):  # many short texts share one product; a long one is cut inside pooled()
            j, n = i, 0
            while j < len(pieces) and (j == i or n + len(pieces[j]) <= 256):
                n += len(pieces[j])
                j += 1
            pooled.append(self.pooled(np.concatenate(pieces[i:j]) if j > i + 1 else pieces[i]))
            i = j
        return self.combine(np.concatenate(pooled), np.array(at))[2].astype(np.float64)

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> tuple[dict, float]:
        """Of the mean log loss over whole documents given as chunk rows."""
        w, rows = self.w, np.concatenate(docs)
        starts = np.cumsum([0, *map(len, docs[:-1])])
        response = self.convolve(rows)
        best = response.argmax(axis=1)
        raw = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + w["bias"]
        pooled = np.maximum(raw, 0)
        feats, hidden, p = self.combine(pooled, starts)
        dz = (p - labels) / len(docs)
        g = {"out": hidden.T @ dz, "out_bias": np.array([dz.sum()])}
        dh = dz[:, None] * w["out"] * (1 - hidden**2)
        g |= {"dense": feats.T @ dh, "dense_bias": dh.sum(axis=0)}
        df = dh @ w["dense"].T
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        top = (pooled == feats[doc, :FILTERS]).astype(np.float64)
        top /= np.add.reduceat(top, starts)[doc]  # equal chunks share
        dpool = df[doc, FILTERS:] / np.bincount(doc)[doc][:, None] + df[doc, :FILTERS] * top
        draw = dpool * (raw > 0)
        g["bias"] = draw.sum(axis=0)
        windows = rows[np.arange(len(rows))[:, None, None], STRIDE * best[:, :, None] + np.arange(WIDTH)]  # chunks, filters, WIDTH
        patches = w["embed"][windows]
        g["conv"] = np.einsum("mf,mfwe->wef", draw, patches, optimize=True).reshape(WIDTH * EMBED, FILTERS)
        back = draw[:, :, None, None] * w["conv"].reshape(WIDTH, EMBED, FILTERS).transpose(2, 0, 1)
        flat = windows.ravel()
        g["embed"] = np.stack([np.bincount(flat, back[..., e].ravel(), 256) for e in range(EMBED)], axis=1)
        return g, float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))

    def fit(self, texts: list, labels: list, steps: int = 900, batch: int = 24, rate: float = 4e-3, seed: int = 11) -> ByteCNN:
        """Adam over shuffled batches of whole documents; the learning rate falls to nothing over the steps."""
        rng, y = np.random.default_rng(seed), np.asarray(labels, np.float32)
        docs = [chunks(t) for t in texts]
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        order: list[int] = []
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = [*order, *rng.permutation(len(docs)).tolist()]
            pick, order = order[:batch], order[batch:]
            g, _ = self.gradients([docs[i] for i in pick], y[pick])
            for k, v in self.w.items():
                d = g[k].astype(np.float32) + 1e-4 * v
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                lr = rate * (1 - (step - 1) / steps)
                self.w[k] = v - lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
        return self


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's text is a multiple of 5: such rows never teach."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """text, label of at most max_rows labelled rows that aren't held out, those with the least hash of the id, and of at most max_bytes of UTF-8.

    The bound holds before anything leaves the executors: a text of more than an eighth of max_bytes isn't taken, and rows are taken in the order of
    the hash as long as they fit.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min("quality").alias("label"))
    picked = known.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), string_col(docs, text_col).alias("text")).filter(F.octet_length("text") <= max_bytes // 8)
    rows = rows.join(F.broadcast(picked.select(F.col(id_col).cast("long").alias("__id"), "label")), "__id").dropDuplicates(["__id"])  # max_rows rows
    order = Window.orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.sum(F.octet_length("text")).over(order)).filter(F.col("so_far") <= max_bytes).select("__id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, steps: int = 900) -> ByteCNN | None:
    """A network fitted on the bounded sample, on the driver; None where the sample lacks one of the labels."""
    rows = sorted(training_sample(docs, labels, id_col, text_col, max_rows, max_bytes).collect(), key=lambda r: r["__id"])
    texts, ys = [r["text"] for r in rows], [r["label"] for r in rows]
    if len(set(ys)) < 2:
        return None
    return ByteCNN().fit(texts, ys, steps=steps)


def score(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """docs with a column score (0 to 1) from the whole text: null and empty texts get the score of no bytes; without a model all score 1.

    All columns stay, whatever they are called, but for an older `score`.
    """
    rest = [c for c in docs.columns if c not in ("score", "__text")]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("__text")
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                texts = part.column(at).to_pylist()
                p = np.ones(len(texts)) if model is None else model.scores(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(rest))), pa.array(p, pa.float64())], [*rest, "score"])

    full = docs.select(*(F.col(f"`{c}`") for c in rest), string_col(docs, text_col).alias("__text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in rest), F.lit(0.0).alias("score")).schema
    return full.mapInArrow(run, schema)
