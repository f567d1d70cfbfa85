"""Operator 8, toxicity by non-negative positive-unlabelled learning.

The risk of a classifier g under class prior pi is estimated from confirmed toxic documents P and unlabelled ones U as
pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the sigmoid loss; where the second term turns negative, the step goes
against it instead (Kiryo et al., 2017). Features are the presence of a word, of a word's first 3 to 7 letters, and of
two or more different words with those first letters; they are chosen among those enriched in P against U, of prefixes
with the same support the longest, and the model is linear over them.

U is drawn from all documents of the training folds, confirmed ones among them, so that pi, the share of toxic ones among
the labelled, is its share of positives, too. The fit reads a bounded sample: at most MAX_P toxic documents and MAX_U of
all, whole texts, picked by hashes of doc_id, and at most MAX_FEATURES features, the most enriched ones (features beyond
that, and such as fewer than three toxic documents of the sample have, weigh nothing). Scoring reads every document, and
nothing but its text.

Edge cases: null text counts as empty and gets the score of a text without features; rows without a label, or with a
null doc_id, are never training examples; repeated rows are scored alike, and count once in the fit; without a toxic
example every score is 0; an empty table gives no row; very long texts are
scored whole, by the presence of features; texts of the same features tie; further columns stay as they are, save score
and predicted, which are replaced (the query returns its own columns only).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.memory import tidied

MAX_P, MAX_U, MAX_FEATURES = 5_000, 20_000, 4_000
FOLDS = 5
EDGES = ".,;:!?|&%#*$\"'()[]{}<>-_=+~"
PREFIXES = (3, 4, 5, 6, 7)
CACHE_WORDS = 150_000
#: Tasks that count the sample's features; each holds those of its share.
SAMPLE_TASKS = 48
STEPS, RATE, DECAY = 800, 0.05, 5e-5


def features(word: str) -> list[str]:
    w = word.strip(EDGES)
    return [w, *(f"^{w[:k]}" for k in PREFIXES if len(w) > k)] if w else []


def words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def levels(found: list[tuple[str, tuple]]) -> set:
    """Features of (word, its features), and (feature, 2) for prefixes of two different words."""
    counts = Counter(f for fs in dict(found).values() for f in fs)
    return set(counts) | {twice(f) for f, n in counts.items() if n > 1}


def twice(feature: str) -> str:
    return f"{feature} {feature}"


def shorter(feature: str) -> str:
    """The feature of one letter less; of a word, its longest prefix."""
    base = feature.split()[0]
    return feature.replace(base, base[:-1] if base[0] == "^" else f"^{base[: min(PREFIXES[-1], len(base) - 1)]}")


def document_features(text: str | None) -> set[str]:
    return levels([(w.strip(EDGES), tuple(features(w))) for w in words(text)])


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def scorer(self):
        weights = self.weights

        class Hits(dict):
            def __missing__(self, word):
                found = tuple(f for f in features(word) if f in weights or twice(f) in weights)
                found = (word.strip(EDGES), found) if found else None
                if len(self) < CACHE_WORDS:
                    self[word] = found
                return found

        hits = Hits()

        def score(text: str | None) -> float:
            found = [x for x in map(hits.__getitem__, words(text)) if x]
            z = self.bias + sum(weights.get(f, 0.0) for f in sorted(levels(found)))
            return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))

        return score


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def training_sample(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> DataFrame:
    """text and is_p (1 for P, 0 for U; a document may be in both) of the bounded sample, without the held-out fold."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("y"))
    ids = docs.where(F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).select("doc_id").join(known, "doc_id", "left")
    ids = ids.select("doc_id", F.coalesce(F.col("y") == 1, F.lit(False)).cast("int").alias("is_p"))
    toxic = ids.where("is_p = 1").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_P)
    every = ids.select("doc_id", F.lit(0).alias("is_p")).distinct().orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(MAX_U)
    picked = F.broadcast(toxic.union(every))  # MAX_P + MAX_U pairs of numbers at most
    return docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "is_p").agg(F.min("text").alias("text")).select("text", "is_p")


def prior_of(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> float:
    """The share of toxic documents among the labelled ones of the training folds; 0 without labels."""
    r = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).agg(F.avg((F.col(column) == 1).cast("double"))).first()
    return float(r[0] or 0.0)


def _counts(sample: DataFrame, only: set[str] | None) -> DataFrame:
    """Documents of the sample that have a feature, by feature (of `only`, where given)."""

    def run(it: Iterator[pa.RecordBatch]):
        seen: Counter[str] = Counter()
        n = 0
        for b in it:
            for t in b.column("text").to_pylist():
                found = document_features(t)
                seen.update(found if only is None else found & only)
                n += 1
        seen[""] = n
        yield pa.RecordBatch.from_pydict({"feature": list(seen), "n": list(seen.values())}, schema=pa.schema([("feature", pa.string()), ("n", pa.int64())]))

    return sample.select("text").mapInArrow(tidied(run), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> Model:
    prior = prior_of(docs, labels, column)
    if not 0 < prior < 1:
        return Model({}, -50.0 if prior == 0 else 50.0, prior)
    sample = training_sample(docs, labels, column).repartition(SAMPLE_TASKS).persist()
    try:
        n_p = sample.where("is_p = 1").count()
        if not n_p:
            return Model({}, -50.0, prior)
        p = {r.feature: r.n for r in _counts(sample.where("is_p = 1"), None).where((F.col("n") >= max(3, n_p // 500)) & (F.col("feature") != "")).collect()}
        u = {r.feature: r.n for r in _counts(sample.where("is_p = 0"), set(p)).collect()}
        n_u = u.pop("", 0)
        gain = {f: (n / n_p - u.get(f, 0) / max(1, n_u)) / np.sqrt((n + u.get(f, 0)) / (n_p + n_u) / n_p) for f, n in p.items()}
        redundant = {g for f in p if (p[f], u.get(f, 0)) == (p.get(g := shorter(f)), u.get(g, 0))}
        chosen = sorted((f for f, z in gain.items() if z > 3 and f not in redundant), key=lambda f: (-gain[f], f))[:MAX_FEATURES]
        index = {f: i for i, f in enumerate(chosen)}

        def rows(it: Iterator[pa.RecordBatch]):
            for b in it:
                out = [np.array(sorted(index[f] for f in document_features(t) if f in index), dtype="<u2").tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("is_p"), pa.array(out, pa.binary())], names=["is_p", "hits"])

        got = sorted((r.is_p, bytes(r.hits)) for r in sample.select("is_p", "text").mapInArrow(tidied(rows), "is_p int, hits binary").collect())
    finally:
        sample.unpersist()
    weights, bias = nnpu([np.frombuffer(h, "<u2") for y, h in got if y], [np.frombuffer(h, "<u2") for y, h in got if not y], len(chosen), prior)
    return Model({f: float(w) for f, w in zip(chosen, weights) if w}, float(bias), prior)


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over the whole sample; rows list present features."""

    def flat(rows):
        return np.concatenate([*rows, np.zeros(0, "<u2")]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (fp, rp), (fu, ru) = flat(positive), flat(unlabelled)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    w, b = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, STEPS + 1):
        zp = np.bincount(rp, w[fp], len(positive)) + b
        zu = np.bincount(ru, w[fu], len(unlabelled)) + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))  # the loss of calling it negative; 1 - s that of calling it positive
        slope_p, slope_u = sp * (1 - sp), su * (1 - su)
        if su.mean() - prior * sp.mean() >= 0:
            gp, gu = -2 * prior * slope_p / n_p, slope_u / n_u
        else:
            gp, gu = prior * slope_p / n_p, -slope_u / n_u
        g = np.append(np.bincount(fp, gp[rp], n) + np.bincount(fu, gu[ru], n) + DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added; every row, from its text alone."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(it: Iterator[pa.RecordBatch]):
        of = model.scorer()
        for b in it:
            s = [of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(tidied(run), f"{schema}, score double, predicted int")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
