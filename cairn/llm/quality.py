"""Operator 13, quality by naive Bayes support vectors (Wang and Manning, 2012).

A text's n-grams are of two kinds: of words (one and two, ASCII and other letters lower-cased) and of shapes (one to
three), where a word's shape keeps runs of lower-case letters, capitals and digits as one sign each and other characters as
they are, and a word that repeats the one before it is a sign of its own. An indicator says that a text has the n-gram; for
shapes further ones say that it makes up a sixteenth, a quarter and a half of the text. Indicators are hashed into 2 **
BITS numbers, so all n-grams count and the model has one size. Each is scaled by its class log-count ratio, and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent. A sigmoid, fitted to margins of documents
that their models had not seen, makes scores of margins.

The fit reads a bounded sample, at most MAX_ROWS labelled documents of the training folds, whole texts, picked by hashes of
doc_id; the driver gets their indicator numbers (SAMPLE_TASKS tasks form them) and fits the model. Scoring reads every
document, and nothing but its text.

Edge cases: a null text counts as empty; a text without words has no indicator and gets the score of the bias, which the
fit learns for a text without indicators as for any other; rows without a label, or with a null doc_id, are never training
examples; labels of one doc_id that differ count as the least; rows that repeat a doc_id are scored alike and count once in
the fit (the least text); without examples of both classes every score is the share of label 1, or 0.5 without any; ties
do not arise, as each text has its own score; an empty table gives no row; very long texts are read whole; further columns
stay as they are, save score and predicted, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.memory import tidied

MAX_ROWS, SAMPLE_TASKS, BITS = 12_000, 48, 18
FOLDS, HELD_OUT, LEAST_SCORE = 4, 2, 0.7
#: Parameters of the fit: smoothing of counts, weight of a mistake, passes, parts for the sigmoid.
SMOOTH, COST, PASSES, PARTS = 1.0, 0.1, 20, 4
#: Shares of a text, in sixteenths, that a shape n-gram's further indicators stand for.
SHARES = (1, 4, 8)
CACHE_WORDS = 200_000
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shape(word: str) -> str:
    """The word's runs: x of lower-case letters (and such without case), X of capitals, 9 of digits, others as they are."""
    end = word[-1] if word and not word[-1].isalnum() else ""
    stem = word[: len(word) - len(end)]
    if stem.isalpha() and (stem.islower() or stem.isupper()):  # the common case, the same as below
        return ("x" if stem.islower() else "X") + end
    signs = "".join("x" if c.islower() else "X" if c.isupper() else "9" if c.isdigit() else "x" if c.isalpha() else c for c in word)
    return re.sub(r"([xX9])\1+", r"\1", signs)[:12]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(ODD[0])
    return h ^ (h >> np.uint64(32))


class Indicators(dict):
    """word -> its number; the hashes of words and shapes are kept by number, all of one batch of texts at least."""

    def __init__(self):
        self.clear()

    def clear(self):
        super().clear()
        self.hashes = np.zeros((2, 1 << 16), np.uint64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        if n == self.hashes.shape[1]:
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], 1)
        self.hashes[:, n] = xxhash.xxh64_intdigest(word.lower().encode()), xxhash.xxh64_intdigest(shape(word).encode(), 1)
        return n

    def of(self, text: str | None) -> np.ndarray:
        """The sorted distinct numbers, below 2 ** BITS, of the indicators of a text."""
        found = (text or "").split()
        if not found:
            return np.zeros(0, np.int64)
        if len(self) > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        word, form = self.hashes[:, at]
        form[1:][at[1:] == at[:-1]] = np.uint64(3)
        all_ = [_mix(word), _mix(_mix(word[:-1]) + word[1:])]
        level, h = form, form
        for length in (1, 2, 3):
            if length > 1:
                h = _mix(h[:-1] * np.uint64(ODD[1]) + form[length - 1 :])
            level, n = np.unique(_mix(h + np.uint64(length)), return_counts=True)
            all_.append(level)
            all_ += [_mix(level[16 * n >= s * len(found)] + np.uint64(16 + s)) for s in SHARES]
        return np.unique(np.concatenate(all_) >> np.uint64(64 - BITS)).astype(np.int64)


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """log of the share of label 1 over that of label 0 among the rows with each indicator."""
    p, q = (SMOOTH + np.bincount(np.concatenate([np.zeros(0, np.int64), *(r for r, v in zip(rows, y) if v == k)]), minlength=1 << BITS) for k in (1, 0))
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the indicators (their scale within) and bias: dual coordinate descent on the L2 hinge loss."""
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    values = [scale[r] / np.sqrt(max(1.0, (scale[r] ** 2).sum())) for r in rows]
    size = np.array([(v * v).sum() + 1 for v in values])
    # both classes weigh the same in sum
    most = COST * np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = sign[i] * (w[r] @ v + b) - 1 + alpha[i] / (2 * most[i])
            new = max(0.0, alpha[i] - slope / (size[i] + 1 / (2 * most[i])))
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * v
                b += step
                alpha[i] = new
    return w, b


@dataclass
class Model:
    """score = sigmoid(slope * margin + shift), the margin of a text whose scaled indicators have length 1."""

    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, row: np.ndarray) -> float:
        v = self.scale[row]
        return float(self.weights[row] @ v / np.sqrt(max(1.0, (v * v).sum())) + self.bias)

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, self.slope * self.margin(row) + self.shift)))))


def sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift of the most likely sigmoid, with a little of either label in each document; Newton steps."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, c = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - goal) + 1e-6 * (c - [1.0, 0.0]))
        c = c - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    none = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Model(none, none, 0.0, 0.0, 50.0 if share == 1 else -50.0 if share == 0 else 0.0)

    def one(use: np.ndarray) -> Model:
        part = [rows[i] for i in np.flatnonzero(use)]
        scale = log_ratios(part, y[use])
        return Model(scale, *hinge(part, y[use], scale))

    margins, part = np.zeros(len(y)), np.arange(len(y)) % PARTS
    for k in range(PARTS):
        m = one(part != k)
        for i in np.flatnonzero(part == k):
            margins[i] = m.margin(rows[i])
    whole = one(np.ones(len(y), bool))
    whole.slope, whole.shift = sigmoid(margins, y)
    return whole


def fold(doc_id: str) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def training_sample(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """doc_id, text, y of at most MAX_ROWS labelled documents of the training folds."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold("doc_id") != HELD_OUT)).distinct().join(known, "doc_id")
    picked = F.broadcast(ids.orderBy(F.xxhash64("doc_id", F.lit("q")), "doc_id").limit(MAX_ROWS))  # MAX_ROWS pairs of numbers
    return docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    def run(it: Iterator[pa.RecordBatch]):
        known = Indicators()
        for b in it:
            found = [known.of(t).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "found"])

    sample = training_sample(docs, labels, column).select("doc_id", "y", "text").repartition(SAMPLE_TASKS)
    got = sorted((r.doc_id, r.y, bytes(r.found)) for r in sample.mapInArrow(tidied(run), "doc_id string, y int, found binary").toLocalIterator())
    return train([np.frombuffer(f, "<u4").astype(np.int32) for _, _, f in got], np.array([y for _, y, _ in got], int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added; every row, from its text alone."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("score", "predicted")])
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2 ** BITS doubles

    def run(it: Iterator[pa.RecordBatch]):
        known, m = Indicators(), shared.value
        for b in it:
            s = [m.score(known.of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= LEAST_SCORE) for x in s], pa.int32())], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(tidied(run), f"{schema}, score double, predicted int")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
