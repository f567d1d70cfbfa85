from fractions import Fraction

import numpy as np
import pytest

from cairn.llm import whitening

D = "/root/testdata/sf0.01"
COLUMNS = "vec_id component n deviation whitened explained identity_error".split()


def by_hand(vectors):
    """x, deviations and covariance in integers and fractions."""
    x = [[int(Fraction(c) * 1024 // 1) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(sum(n * r[i] * n * r[j] for r in x) - n * s[i] * s[j], n**3) for j in range(d)] for i in range(d)]
    return x, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x], np.array([[float(v) for v in row] for row in cov])


def test_query_by_brute_force(spark):
    got = whitening.op11_query(spark, D).collect()
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x, deviation, cov = by_hand([rows[i] for i in ids])
    assert len(got) == 8 * len(ids) and set(COLUMNS) <= set(got[0].asDict())
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    far = np.array(x, float) - np.array([float(Fraction(sum(c), len(x))) for c in zip(*x)])
    want = np.abs(far @ v / np.sqrt(e))
    at = {i: k for k, i in enumerate(ids)}
    sign = {}
    for r in got:
        assert r.n == len(ids) and r.deviation == deviation[at[r.vec_id]] == int(r.deviation_text)
        assert abs(abs(r.whitened) - want[at[r.vec_id], r.component - 1]) < 1e-9
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-12 and r.identity_error < 1e-9
        if want[at[r.vec_id], r.component - 1] > 1e-6:
            sign.setdefault(r.component, set()).add(np.sign(r.whitened * (far @ v)[at[r.vec_id], r.component - 1]))
    assert all(len(s) == 1 for s in sign.values())


@pytest.mark.parametrize("far", [3, 2**19, 2**30, 2**45, 2**62, 10**30])
def test_cross_products_are_exact(far):
    rng = np.random.default_rng(far % 97)
    x = [[int(rng.integers(-1000, 1000)) * far // 1000 for _ in range(3)] for _ in range(50)]
    got = whitening.cross(np.array(x, np.int64 if far < 2**62 else object))
    assert [[int(v) for v in r] for r in got] == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]


def test_whole_numbers():
    c = np.array([[0.5, -1e-9, 1 / 3], [2.0**60 + 2**10, -(2.0**300), 1e-300]])
    assert whitening.whole(c).tolist() == [[int(Fraction(v) * 1024 // 1) + 100_000 for v in r] for r in c.tolist()]


def test_result_is_the_same_under_any_order_and_split(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5) * 10.0 ** rng.integers(-3, 9)]) for i in range(300)]
    a, b = (whitening.fit(whitening.usable(spark.createDataFrame(rs, "vec_id long, embedding array<double>").repartition(k), "vec_id", "embedding"))[5] for rs, k in ((rows, 1), (rows[::-1], 7)))
    assert a.sums == b.sums and a.values.tolist() == b.values.tolist() and a.vectors.tolist() == b.vectors.tolist()


def test_edges(spark):
    schema = "vec_id long, embedding array<double>, n string, d int"
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11), 1.0], "x", 4) for i in range(30)] + [(3, [3.0, 9.0, 1.0], None, None), (None, [1.0, 2.0, 1.0], "y", 1)]
    bad = [(90, None, "x", 1), (91, [1.0, None, 2.0], "x", 1), (92, [nan, 1.0, 1.0], "x", 1), (93, [inf, 1.0, 1.0], "x", 1), (94, [], "x", 1)]
    got = whitening.whiten(spark.createDataFrame(good + bad, schema)).collect()
    assert len(got) == 3 * len(good) and not any(r.vec_id in range(90, 95) for r in got)  # an empty vector has no component
    _, deviation, _ = by_hand([g[1] for g in good])
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component == 3)  # the constant dimension
    assert max(r.identity_error for r in got) < 1e-9 and sum(r.vec_id == 3 for r in got) == 6

    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], "", 0)], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 2
    mixed = whitening.whiten(spark.createDataFrame([(i, [float(i)] * (1 + i % 2), "", 0) for i in range(10)], schema)).collect()
    assert sorted({(r.vec_id % 2, r.n) for r in mixed}) == [(0, 5), (1, 5)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300], "", 0), (2, [-1e300], "", 0)], schema)).collect()
    assert [r.deviation for r in huge] == [None, None] and int(huge[0].deviation_text) == (2 * (int(1e300) * 1024)) ** 2 and {round(r.whitened, 9) for r in huge} == {-1.0, 1.0}
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
