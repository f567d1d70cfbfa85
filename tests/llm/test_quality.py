import zlib

import numpy as np

from cairn.llm import quality

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality.op13_query(spark, D).collect()}
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) and g.predicted == int(g.score >= 0.7) and 0 <= g.score <= 1 for g in got.values())
    held = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{D}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    low = [g for y, g in held if y == 0]
    high = [g for y, g in held if y == 1]
    assert sum(g.predicted == 0 for g in low) / len(low) >= 0.95 and sum(g.predicted == 1 for g in high) / len(high) >= 0.99


def test_dual_descent_reaches_the_least_loss():
    """Weights of a small problem against plain gradient descent on the primal (squared) hinge loss."""
    rng = np.random.default_rng(0)
    x = (rng.random((60, 6)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] > x[:, 2] + 0.5).astype(int)
    y[:4] ^= 1
    rows = [np.flatnonzero(r) for r in x]
    scale = rng.normal(size=6)
    cost = quality.COST * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    z = x * scale
    z = np.c_[z / np.sqrt(np.maximum(1, (z * z).sum(1)))[:, None], np.ones(60)]
    sign = np.where(y == 1, 1.0, -1.0)

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (z @ w)) ** 2).sum()

    w = np.zeros(7)
    for _ in range(20_000):
        w -= 0.01 * (w - 2 * z.T @ (cost * sign * np.maximum(0, 1 - sign * (z @ w))))
    got, bias = quality.hinge(rows, y, scale)
    assert loss(np.r_[got, bias]) <= loss(w) * 1.001


def test_log_ratios_by_hand():
    rows, y = [np.array([0, 1]), np.array([1]), np.array([2])], np.array([1, 1, 0])
    got = quality.log_ratios(rows, y)
    m = 1 << quality.BITS
    assert np.allclose(got[:3], [np.log((2 / (3 + m)) / (1 / (1 + m))), np.log((3 / (3 + m)) / (1 / (1 + m))), np.log((1 / (3 + m)) / (2 / (1 + m)))])


def test_indicators():
    assert [quality.shape(w) for w in ("word", "Word.", "OF!!", "a1B22", "中文", "|", "x###", "")] == ["x", "Xx.", "X!!", "x9X9", "x", "|", "x###", ""]
    one = quality.Indicators()
    a, b = one.of("The cat sat"), quality.Indicators().of("zz The cat sat")
    assert np.array_equal(a, one.of("The  cat\nsat")) and len(np.intersect1d(a, b)) > 5
    assert not len(one.of(None)) and not len(one.of(" \n"))
    one.update({f"w{i}": i for i in range(quality.CACHE_WORDS + 1)})
    assert np.array_equal(a, one.of("The cat sat"))  # a full cache is emptied, not wrong


def test_edges(spark):
    schema = "doc_id long, text string, score string, predicted string, quality int"
    junk, fine = "BUY!! NOW!! " * 9, "a quiet line of prose about rivers "
    rows = [(i, (junk if i % 3 == 0 else fine) + f"w{i}", "s", "p", 5) for i in range(90)]
    more = [(None, None, None, None, None), (None, fine, "s", "p", 1), (3, junk + "w3", "s", "p", 5), (200, "", "s", "p", 1), (201, fine * 30_000, "s", "p", 1), (202, junk * 30_000, "s", "p", 1)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(90)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + more, schema)
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + len(more) and got[0].asDict().keys() == {"doc_id", "text", "quality", "score", "predicted"}
    by = {(r.doc_id, (r.text or "")[:3]): r for r in got}
    assert by[(201, "a q")].predicted == 1 and by[(202, "BUY")].predicted == 0 and by[(None, "a q")].predicted == 1
    assert by[(200, "")].score == by[(None, "")].score
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and sum(r.doc_id == 3 for r in got) == 2
    for part, want in ((labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.limit(0), 0.5)):
        assert {round(r.score, 9) for r in quality.score(docs, quality.fit(docs, part)).collect()} == {want}
    empty = spark.createDataFrame([], schema)
    assert quality.score(empty, quality.fit(empty, labels)).collect() == []
