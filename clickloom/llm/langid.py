"""Language identification by a byte convolutional network, trained in numpy.

A window of `WINDOW` bytes goes through filters of several widths (one weight per filter, place and byte
value), a rectifier, max pooling over the window and a softmax layer. It is trained on windows of at most
`TRAIN_DOCS` labelled texts, taken by the hash of their id (the documented bound of the classifier's sample).
A text is cut into windows that cover all of it; its logits are the mean over windows, weighted by their bytes.

Defined cases: null texts and texts without a letter are `und` with score 0; without labelled rows all texts
are; repeated rows are scored alike; an empty table gives no rows; columns other than doc_id, text and (for
training rows) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import bucket, by_bytes, read, small_batches, utf8

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
TRAIN_DOCS, WINDOWS_PER_DOC = 4000, 3
STEPS, BATCH, STEP_SIZE, DECAY = 700, 64, 0.01, 1e-4
UNKNOWN = "und"


class Network:
    """Weights: one (width, 256, FILTERS) table per width, a bias, and a dense layer."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.bias, self.dense, self.offset]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima per filter, and the places of the maxima."""
        out, places = [], []
        for table, bias in zip(self.tables, self.bias):
            n = x.shape[1] - len(table) + 1
            maps = sum(table[k][x[:, k : k + n]] for k in range(len(table)))
            top = maps.argmax(1)
            out.append(np.take_along_axis(maps, top[:, None], 1)[:, 0] + bias)
            places.append(top)
        return np.maximum(np.concatenate(out, 1), 0), places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        hidden, places = self.pooled(x)
        logits = hidden @ self.dense + self.offset
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        prob /= len(y)
        back = (prob @ self.dense.T) * (hidden > 0)
        tables, biases = [], []
        for i, (table, top) in enumerate(zip(self.tables, places)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(table)
            for k in range(len(table)):
                byte = np.take_along_axis(x, top + k, 1)
                np.add.at(grad[k], (byte, np.arange(FILTERS)[None]), g)
            tables.append(grad + DECAY * table)
            biases.append(g.sum(0))
        return [*tables, *biases, hidden.T @ prob + DECAY * self.dense, prob.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> None:
        """Adam on random batches."""
        rng = np.random.default_rng(seed)
        m, v = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        for step in range(1, STEPS + 1):
            some = rng.integers(0, len(y), BATCH)
            for p, g, a, b in zip(self.parameters(), self.gradients(x[some], y[some]), m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= STEP_SIZE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def fast(self) -> list[list[np.ndarray]]:
        """Tables over byte pairs: a width w takes w // 2 pair lookups and w % 2 single ones."""
        out = []
        for table in self.tables:
            pairs = [(table[k][:, None] + table[k + 1][None]).reshape(65536, FILTERS) for k in range(0, len(table) - 1, 2)]
            out.append(pairs + ([table[-1]] if len(table) % 2 else []))
        return out


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (the last one of a text is filled up with 0), the text of each, and its bytes."""
    n = np.diff(offsets)
    count = np.maximum(-(-n // WINDOW), 1)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(WINDOW, n[row] - k * WINDOW)
    at = (offsets[row] + k * WINDOW)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    if not len(data):
        return np.zeros((len(row), WINDOW), np.uint8), row, size
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), row, size


def logits(net: Network, fast: list[list[np.ndarray]], x: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Logits of every window."""
    out = np.zeros((len(x), len(net.labels)))
    for i in range(0, len(x), chunk):
        part = x[i : i + chunk]
        pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
        hidden = []
        for tables, bias, width in zip(fast, net.bias, WIDTHS):
            n = WINDOW - width + 1
            maps = np.take(tables[0], pair[:, :n], axis=0)
            for k, t in enumerate(tables[1:], 1):
                maps += np.take(t, pair[:, 2 * k : 2 * k + n] if len(t) > 256 else part[:, 2 * k : 2 * k + n], axis=0)
            hidden.append(maps.max(1) + bias)
        out[i : i + chunk] = np.maximum(np.concatenate(hidden, 1), 0) @ net.dense + net.offset
    return out


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Network | None:
    """A network trained on labelled rows of `docs` (doc_id, text, lang)."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    chosen = rows.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def sample(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for text, lang, ident in zip(*(c.to_pylist() for c in b.columns)):
                raw = np.frombuffer(text.encode(), np.uint8)
                x, _, size = windows(raw, np.array([0, len(raw)]))
                some = np.linspace(0, len(x) - 1, min(len(x), WINDOWS_PER_DOC)).astype(int)
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(some)), pa.array([lang] * len(some), pa.string()),
                                                  pa.array([x[i].tobytes() for i in some], pa.binary())], ["doc_id", "lang", "x"])

    # The ids of the sample are few (TRAIN_DOCS at most), so they may be broadcast; windows are what reaches the driver.
    found = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", "doc_id")
    found = found.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("text", "lang", "doc_id")
    got = found.mapInArrow(sample, "doc_id long, lang string, x binary").orderBy("doc_id", "lang", "x").limit(most * WINDOWS_PER_DOC).toPandas()
    if got.empty:
        return None
    labels = sorted(got["lang"].unique())
    net = Network(labels)
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, WINDOW)
    net.train(x.astype(np.int64), np.searchsorted(labels, got["lang"].to_numpy(str)))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("known"))
    if net is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        fast = net.fast()
        for b in by_bytes(frames, 1, 1 << 20):
            data, offsets = utf8(b.column(1))
            x, row, size = windows(data, offsets)
            z = logits(net, fast, x) * np.maximum(size, 1)[:, None]
            z = np.stack([np.bincount(row, c, b.num_rows) for c in z.T], 1) / np.maximum(np.diff(offsets), 1)[:, None]
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            known = b.column(2).to_numpy(zero_copy_only=False)
            best = prob.argmax(1)
            names = np.where(known, np.array(net.labels, object)[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(known, prob.max(1), 0.0))], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = fit(docs.where(bucket("doc_id", 3) != 1))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
