"""Operator 11, embedding whitening from an exact integer scatter.

Entries become whole numbers, x = floor(scale * c) + offset. Tasks subtract a shift (one row's numbers, which keeps them
small) and add up sums and cross-products of arbitrary precision: products are formed in doubles from limbs of LIMB bits,
at most ROWS rows at once, so no product or sum leaves the 53 bits that doubles hold exactly, and are then added as
integers. n * X'X - S S' is formed in integers too and is the same under any shift; only its quotients by n * n become
doubles, each rounded once, and eigh decomposes them. Rows are read once more to be projected.

Sums of a dimension and its cross-products with later ones go through the shuffle as one row a task and dimension; the
driver gets the merged ones, d * d numbers for d dimensions, whatever the number of rows.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped; all others count, repeated rows
and null ids too. Vectors of another length have another covariance: each length is fitted by itself (an empty vector has
no component). A component without variance (constant or dependent dimensions, a single row) gets whitened and explained 0
and no part in identity_error; equal eigenvalues take the order that eigh gives them. An empty table gives no row; further
columns are ignored. Entries may be so large that x has more than 64 bits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.memory import tidied
from cairn.session import materialize

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Bits of a limb and rows of a block: 2 * LIMB + log2(ROWS) is at most 53.
LIMB, ROWS = 20, 4096
#: Eigenvalues below this share of the largest are rounding.
LEAST_SHARE = 1e-12


def usable(embeddings: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vec, an array of doubles, of the rows that count."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.select(F.col(vec_id).alias("vec_id"), v.alias("vec")).where(v.isNotNull() & F.coalesce(finite, F.lit(False)))


def whole(c: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET: int64, or Python integers where that is too short."""
    if not c.size or np.abs(c).max() < 2.0**50:
        return np.floor(c * SCALE).astype(np.int64) + OFFSET
    exact = [int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in c.ravel()]  # such doubles are whole
    return np.array([v + OFFSET for v in exact], object).reshape(c.shape)


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, matrix of their vectors) for each length of vectors."""
    vec = b.column("vec")
    size = vec.value_lengths().to_numpy(zero_copy_only=False)
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        yield at, flat[start[at][:, None] + np.arange(d)]


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles of LIMB bits whose sum, each times 2 ** (LIMB * its place), is x; the last has the sign."""
    out = []
    while x.size and max(abs(int(x.max())), abs(int(x.min()))) >> LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


def cross(x: np.ndarray) -> np.ndarray:
    """X'X of at most ROWS rows of integers, in Python integers."""
    limbs = _limbs(x)
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total = total + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return total


def _sums(shifts: dict[int, list[int]]):
    def run(it: Iterator[pa.RecordBatch]):
        held: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in it:
            for _, vec in _vectors(b):
                d = vec.shape[1]
                shift = np.array(shifts[d], object)
                shift = shift.astype(np.int64) if max(map(abs, shifts[d])) < 1 << 61 else shift
                for lo in range(0, len(vec), ROWS):
                    x = whole(vec[lo : lo + ROWS]) - shift
                    n, s, q = held.get(d, (0, 0, 0))
                    held[d] = n + len(x), s + x.astype(object).sum(0), q + cross(x)
        for d, (n, s, q) in held.items():
            rows = [json.dumps([n, int(s[i]), *map(int, q[i, i:])]) for i in range(d)]
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "sums": pa.array(rows)})

    return run


def _add(it: Iterator[pa.RecordBatch]):
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in it:
        for d, i, sums in zip(*(c.to_pylist() for c in b.columns)):
            new = np.array(json.loads(sums), object)
            total[d, i] = total[d, i] + new if (d, i) in total else new
    for (d, i), sums in total.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "i": pa.array([i], pa.int32()), "sums": [json.dumps([int(v) for v in sums])]})


@dataclass
class Fit:
    """n rows with sums S per dimension, unit eigenvectors by column, their eigenvalues and the trace of the covariance.

    Those are of x / 2 ** down; down is 0 unless squares leave the range of doubles.
    """

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    down: int = 0

    def whitener(self) -> np.ndarray:
        live = self.live()
        return self.vectors * np.where(live, 1 / np.sqrt(np.where(live, self.values, 1.0)), 0.0)

    def live(self) -> np.ndarray:
        return self.values > LEAST_SHARE * max(0.0, self.values[0]) if len(self.values) else np.zeros(0, bool)

    def explained(self) -> np.ndarray:
        return np.where(self.live(), self.values / (self.trace or 1.0), 0.0)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors, by length."""
    first = vectors.where(F.size("vec") > 0).groupBy(F.size("vec").alias("d")).agg(F.first("vec").alias("v")).collect()  # one vector a length
    shifts = {r.d: [int(x) for x in whole(np.array(r.v))] for r in first}
    partial = vectors.select("vec").mapInArrow(tidied(_sums(shifts)), "d int, i int, sums string")
    rows = partial.repartition("d", "i").mapInArrow(tidied(_add), "d int, i int, sums string").collect()  # d * d numbers
    out = {}
    for d, shift in shifts.items():
        got = {r.i: json.loads(r.sums) for r in rows if r.d == d}
        n, s = got[0][0], [got[i][1] for i in range(d)]
        scatter = {(i, j): n * got[i][2 + j - i] - s[i] * s[j] for i in range(d) for j in range(i, d)}
        down = max(0, max(v.bit_length() for v in scatter.values()) - 900) // 2
        cov = np.zeros((d, d))
        for (i, j), v in scatter.items():
            cov[i, j] = cov[j, i] = v / (n * n << 2 * down)  # of integers, rounded once
        values, axes = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:components]
        out[d] = Fit(n, [s[i] + n * shift[i] for i in range(d)], axes[:, order], values[order], float(np.trace(cov)), down)
    return out


def project(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """vec_id, d, n, deviation (a whole number as text), whitened (an array by component) of every row."""
    ready = {d: (f.n, f.sums, f.whitener(), f.down) for d, f in fits.items()}
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]):
        for b in it:
            for at, vec in _vectors(b):
                n, sums, w, down = ready[vec.shape[1]]
                x = whole(vec)
                bound = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
                far = x * n - np.array(sums) if bound < 1 << 62 else x.astype(object) * n - np.array(sums, object)
                most = max(abs(int(far.max())), abs(int(far.min())))
                exact = far if most * most * len(sums) < 1 << 63 else far.astype(object)
                deviation = [str(int(v)) for v in (exact * exact).sum(1)]
                centred = (far / (n << down)).astype(float)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), pa.array([len(sums)] * len(at), pa.int32()), pa.array([n] * len(at), pa.int64()), pa.array(deviation), pa.array(list(centred @ w), pa.list_(pa.float64()))], names=["vec_id", "d", "n", "deviation", "whitened"])

    return vectors.mapInArrow(tidied(run), f"vec_id {kind}, d int, n long, deviation string, whitened array<double>")


def identity_errors(whitened: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """The largest absolute entry of the covariance of the written whitened vectors, less the identity, by length."""
    out = {}
    for d, f in fits.items():
        live = np.flatnonzero(f.live())
        if not len(live):
            out[d] = 0.0
            continue
        rows, at = whitened.where(F.col("d") == d), lambda i: F.col("whitened")[int(i)]
        means = rows.agg(*[F.avg(at(i)) for i in live]).first()
        pairs = [(p, q) for p in range(len(live)) for q in range(p, len(live))]
        cov = rows.agg(*[F.avg((at(live[p]) - F.lit(means[p])) * (at(live[q]) - F.lit(means[q]))) for p, q in pairs]).first()
        out[d] = max(abs(c - (p == q)) for c, (p, q) in zip(cov, pairs))
    return out


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text for every usable row and component.

    deviation is null where it doesn't fit 64 bits; deviation_text always holds it.
    """
    vectors = usable(embeddings, vec_id, vector)
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    fits = fit(vectors, components)
    if not fits:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string")
    rows = materialize(project(vectors, fits), "whitened")
    errors = identity_errors(rows, fits)
    shares = spark.createDataFrame([(d, i, float(s), errors[d]) for d, f in fits.items() for i, s in enumerate(f.explained())], "d int, i int, explained double, identity_error double")
    each = rows.select("vec_id", "d", "n", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    joined = each.join(F.broadcast(shares), ["d", "i"])  # the components of each length
    return joined.select("vec_id", (F.col("i") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_text"))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
