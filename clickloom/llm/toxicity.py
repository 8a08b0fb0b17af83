"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features: densities of two learned lexicons (strong and weak stems), hits near second-person words, second
person, capitals, shouted words, punctuation and obfuscation rates, length. The lexicons are stems (a word or
its first 4, 5 or 6 bytes) that far more toxic than clean training texts contain. Counts of stems come from
Spark; trees and calibration are fitted in numpy on at most `TRAIN_ROWS` labelled rows, taken by the hash of
their id (the documented bound of the classifier's sample). Each training row gets its features from a lexicon,
and its calibration score from trees, that have not seen its fold.

Defined cases: null text is empty and gets the score of an empty text; labels with null toxic or id are
ignored, repeated labels count as toxic if one of them is; repeated documents are scored alike; without
training rows of both kinds every score is the share of toxic rows (0.0 without rows); an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import LOWER, bucket, by_bytes, read, small_batches, span_hashes, sums, tidy, utf8, words, written

TRAIN_ROWS = 20_000
FOLDS = 5
PREFIXES = (4, 5, 6)
#: Least log odds of strong and weak stems, least toxic texts with a stem, stems per lexicon at most.
STRONG, WEAK, SUPPORT, STEMS = 3.0, 1.5, 3, 4096
NEAR = 3
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton tes vous votre vos
usted ustedes vosotros ti contigo""".split()

#: Bytes that part words: white space and ASCII punctuation, but for signs that stand in for letters.
PART = np.zeros(256, bool)
PART[:128] = [not chr(i).isalnum() and chr(i) not in "*@$_#" for i in range(128)]
UPPER, DIGIT, SIGN = np.zeros((3, 256), bool)
UPPER[65:91] = DIGIT[48:58] = True
SIGN[[ord(c) for c in "*@$_#"]] = True
LETTER = UPPER.copy()
LETTER[97:123] = LETTER[128:] = True


def _hashes(items: list[str]) -> np.ndarray:
    raw = [x.encode() for x in items]
    ends = np.cumsum([len(x) for x in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends))


SECOND = _hashes(SECOND_PERSON)


def stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word (row 0) and of its prefixes (rows 1..); 0 where a word is shorter."""
    out = np.zeros((1 + len(PREFIXES), len(starts)), np.uint64)
    out[0] = span_hashes(data, starts, ends)
    for i, n in enumerate(PREFIXES, 1):
        long = np.flatnonzero(ends - starts > n)
        out[i, long] = span_hashes(data, starts[long], starts[long] + n)
    return out


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(values.shape, bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


FEATURES = ["strong", "weak", "strong_hits", "near_you", "you", "capitals", "shouted", "exclaim", "question", "punctuation", "repeated",
            "obfuscated", "digits", "log_words", "mean_word"]


def features(data: np.ndarray, offsets: np.ndarray, strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    raw, low = data, LOWER[data]
    starts, ends, rows = words(low, offsets, PART)
    n_bytes, n_words = np.diff(offsets), np.diff(rows)
    letters, signs, digits, capitals = (sums(t[raw], offsets) for t in (LETTER, PART, DIGIT, UPPER))
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(n_bytes, 1)
    found = stems(low, starts, ends)
    hit, soft = (_in(found, t).any(0) for t in (strong, weak))
    you = _in(found[0], SECOND)
    total = np.concatenate([[0], np.cumsum(you)])
    row = np.repeat(np.arange(len(n_words)), n_words)
    at = np.arange(len(starts))
    close = total[np.minimum(at + NEAR + 1, rows[1:][row])] - total[np.maximum(at - NEAR, rows[:-1][row])] > 0
    upper = np.concatenate([[0], np.cumsum(UPPER[raw])])
    shouted = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    mixed = np.concatenate([[0], np.cumsum(SIGN[raw] | DIGIT[raw])])
    mixed = mixed[ends] - mixed[starts]
    obfuscated = (mixed > 0) & (mixed < ends - starts)
    same = np.zeros(len(low), bool)
    if len(low) > 2:
        same[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & LETTER[low[2:]]
    of = lambda mask: sums(mask, rows) * per_word
    hits = sums(hit, rows)
    columns = [hits * per_word, of(soft & ~hit), np.minimum(hits, 50), of((hit | soft) & close), of(you), capitals / np.maximum(letters, 1),
               of(shouted), sums(raw == 33, offsets) * per_byte, sums(raw == 63, offsets) * per_byte, signs * per_byte,
               sums(same, offsets) * per_byte, of(obfuscated), digits * per_byte, np.log1p(n_words), n_bytes * per_word]
    return np.stack(columns, 1).astype(np.float64)


# --- trees -----------------------------------------------------------------------------------------------------

TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 3, 0.2, 32, 10, 1.0


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold per inner node, value per leaf; go right where x > threshold."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on quantile bins, one histogram pass a level."""
    p = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))))
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    # Few rows hit the lexicon, so quantiles alone would leave no cut between none and some.
    cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 9)[:-1]) * 0.999])) if len(v := x[x[:, j] > 0, j]) else c for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    width = max(map(len, cuts)) + 1
    margin = np.full(len(y), model.base)
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = y - prob, prob * (1 - prob)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-9)
            cell = np.full(n, width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * width + binned[:, j]
                g, h, k = (np.bincount(key, w, n * width).reshape(n, width).cumsum(1) for w in (grad, hess, None))
                left, right = slice(0, len(c)), [m[:, -1:] - m[:, : len(c)] for m in (g, h, k)]
                gain = g[:, left] ** 2 / (h[:, left] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(k[:, left] < LEAF) | (right[2] < LEAF)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(n), top]
                for i in np.flatnonzero(value > best):
                    best[i], cell[i] = value[i], top[i]
                    feature[first + i], threshold[first + i] = j, c[top[i]]
            right_side = binned[np.arange(len(y)), feature[node]] > cell[node - first]
            node = 2 * node + 1 + (right_side & np.isfinite(threshold[node]))
        leaf = node - (2**DEPTH - 1)
        g, h = (np.bincount(leaf, w, 2**DEPTH) for w in (grad, hess))
        value = RATE * g / (h + RIDGE)
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
        margin += value[leaf]
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending scores and their calibrated values, for linear interpolation."""
    order = np.argsort(score, kind="stable")
    at, inverse = np.unique(score[order], return_inverse=True)
    total, n = np.bincount(inverse, y[order]), np.bincount(inverse)
    blocks: list[list[float]] = []  # sum, rows, values
    for s, k in zip(total, n):
        blocks.append([s, k, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, k2, m2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + k2, blocks[-1][2] + m2]
    return at, np.concatenate([np.full(m, s / k) for s, k, m in blocks]) if blocks else np.zeros(0)


@dataclass
class Model:
    strong: np.ndarray
    weak: np.ndarray
    trees: Trees
    at: np.ndarray
    to: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(features(data, offsets, self.strong, self.weak))
        out = np.interp(margin, self.at, self.to) if len(self.at) else 1 / (1 + np.exp(-margin))
        return np.clip(out, 0.0, 1.0)


# --- fitting on Spark ------------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, fold, toxic and text of the sample, one row per label. At most `most` labels are broadcast (20 bytes each)."""
    found = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = found.withColumn("fold", bucket("doc_id", FOLDS).cast("int")).where("fold <> 0")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(found), "doc_id")


def count_stems(rows: DataFrame) -> DataFrame:
    """Per stem: texts with it by fold and label (columns n<fold>_<label>), for stems with enough toxic texts."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(frames, 0):
            data, offsets = utf8(b.column(0))
            low = LOWER[data]
            starts, ends, row = words(low, offsets, PART)
            kind = (b.column(1).to_numpy() * 2 + b.column(2).to_numpy()).astype(np.uint64)
            found = stems(low, starts, ends)
            doc = np.broadcast_to(np.repeat(np.arange(len(kind)), np.diff(row)), found.shape)
            keep = found != 0
            pairs = np.unique(np.stack([found[keep], doc[keep].astype(np.uint64)], 1), axis=0) if keep.any() else np.zeros((0, 2), np.uint64)
            both, n = np.unique(np.stack([pairs[:, 0], kind[pairs[:, 1].astype(np.int64)]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (both[:, 0], both[:, 1], n)], ["stem", "kind", "n"])

    counted = rows.select("text", "fold", "toxic").mapInArrow(tidy(count), "stem long, kind long, n long").groupBy("stem")
    columns = [F.sum(F.when(F.col("kind") == 2 * fold + y, F.col("n")).otherwise(0)).alias(f"n{fold}_{y}") for fold in range(1, FOLDS) for y in (0, 1)]
    toxic = sum((F.col(f"n{fold}_1") for fold in range(1, FOLDS)), F.lit(0))
    return counted.agg(*columns).where(toxic >= SUPPORT)


def lexicon(table: dict[str, np.ndarray], kinds: dict[tuple[int, int], int], without: int) -> tuple[np.ndarray, np.ndarray]:
    """Strong and weak stems by the texts of all folds but one."""
    folds = [f for f in range(1, FOLDS) if f != without]
    toxic, clean = (sum(table[f"n{f}_{y}"] for f in folds) for y in (1, 0))
    n_toxic, n_clean = (sum(kinds.get((f, y), 0) for f in folds) for y in (1, 0))
    odds = np.log((toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1)))
    out = []
    for low, high in ((STRONG, np.inf), (WEAK, STRONG)):
        chosen = np.flatnonzero((odds >= low) & (odds < high) & (toxic >= SUPPORT))
        chosen = chosen[np.argsort(-toxic[chosen], kind="stable")[:STEMS]]
        out.append(np.sort(table["stem"][chosen].astype(np.int64).astype(np.uint64)))
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    rows = written(training_rows(docs, labels, most), "toxicity-sample")
    kinds = {(r.fold, r.toxic): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    # Stems with enough toxic texts; strongest first, so that the table that reaches the driver has a fixed bound.
    stems_found = count_stems(rows)
    toxic = sum((F.col(f"n{f}_1") for f in range(1, FOLDS)), F.lit(0))
    clean = sum((F.col(f"n{f}_0") for f in range(1, FOLDS)), F.lit(0))
    table = stems_found.orderBy(F.desc((toxic + 0.5) / (clean + 0.5) * F.log1p(toxic)), "stem").limit(4 * STEMS).toPandas()
    table = {c: table[c].to_numpy() for c in table.columns}
    pairs = {f: lexicon(table, kinds, f) for f in range(FOLDS)}  # fold 0 is held out: its lexicon is that of all others

    def describe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(frames, 0):
            data, offsets = utf8(b.column(0))
            fold = b.column(1).to_numpy()
            x = np.zeros((len(fold), len(FEATURES)))
            for f in np.unique(fold):
                own = np.flatnonzero(fold == f)
                some = b.column(0).take(pa.array(own))
                x[own] = features(*utf8(some), *pairs[int(f)])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array(c) for c in x.T)], ["fold", "toxic", *FEATURES])

    schema = "fold int, toxic int, " + ", ".join(f"{c} double" for c in FEATURES)
    got = rows.select("text", "fold", "toxic").mapInArrow(tidy(describe), schema).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    x, y, fold = got[FEATURES].to_numpy(), got["toxic"].to_numpy(float), got["fold"].to_numpy()
    margin = np.zeros(len(y))
    for f in np.unique(fold):
        margin[fold == f] = fit_trees(x[fold != f], y[fold != f]).margin(x[fold == f])
    at, to = fit_isotonic(margin, y)
    return Model(*pairs[0], fit_trees(x, y), at, to)


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score and predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(frames, 1):
            p = shared.value.score(*utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [ident, "score", "predicted"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, F.col(text).cast("string")).mapInArrow(tidy(rate), f"`{ident}` {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is below 0.5, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, text = list(docs.columns), docs.columns.index("text")

    def keep(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(frames, text):
            yield b.filter(pa.array(shared.value.score(*utf8(b.column(text))) < 0.5))

    return docs.mapInArrow(tidy(keep), ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)).select(*names)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
