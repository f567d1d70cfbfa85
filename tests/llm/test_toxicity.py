import zlib

import numpy as np

from cairn.llm import toxicity

D = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op8_query(spark, D).collect()}
    docs = spark.read.parquet(f"{D}/documents.parquet").count()
    assert len(got) == docs
    held = [(r.toxic, got[r.doc_id]) for r in spark.read.parquet(f"{D}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) and g.predicted == int(g.score >= 0.5) and 0 <= g.score <= 1 for g in got.values())
    tp = sum(y == 1 and g.predicted for y, g in held)
    fp = sum(y == 0 and g.predicted for y, g in held)
    toxic = sum(y for y, _ in held)
    print("held-out", tp, fp, toxic, len(held))
    assert tp / toxic >= 0.88 and fp / (len(held) - toxic) <= 0.01


def test_risk_is_non_negative_and_separates():
    rng = np.random.default_rng(1)
    p = [np.array([0, 1 + rng.integers(4)]) for _ in range(40)]
    u = [np.array([1 + rng.integers(4)]) for _ in range(360)] + p[:40]
    w, b = toxicity.nnpu(p, u, 5, 0.1)
    assert w[0] + b > 0 > b + w[1:].max()


def test_unlabelled_sample_is_of_all_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(7, "text 7")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.training_sample(docs, labels).collect()
    train = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    assert sorted(r.text for r in got if r.is_p) == sorted(f"text {i}" for i in train if i % 4 == 0)
    assert sorted(r.text for r in got if not r.is_p) == sorted(f"text {i}" for i in train)


def test_risk_by_brute_force():
    """Weights of two tiny samples against a grid search over the non-negative risk."""
    p, u = [np.array([0])] * 3, [np.array([0])] * 3 + [np.array([], dtype=int)] * 7
    prior = 0.3

    def risk(w, b):
        s = lambda z: 1 / (1 + np.exp(-z))
        zp, zu = w + b, np.array([w + b] * 3 + [b] * 7)
        return prior * (1 - s(zp)) + max(0.0, s(zu).mean() - prior * s(zp))

    w, b = toxicity.nnpu(p, u, 1, prior)
    grid = min(risk(x, y) for x in np.linspace(-20, 20, 81) for y in np.linspace(-20, 20, 81))
    assert risk(w[0], b) <= grid + 0.02 and w[0] + b > 0 > b


def test_edges(spark):
    schema = "doc_id long, text string, score string, toxic int"
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, toxic int")
    rows = [(i, "vile words here" if i % 2 else "calm words here", "x", 9) for i in range(60)] + [(None, None, None, None), (3, "vile words here", "x", 9), (100, "", "x", 1), (101, "vile " + "calm " * 60000, "x", 0)]
    docs = spark.createDataFrame(rows, schema)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and got[0].toxic == 9
    by = {(r.doc_id, r.text[:9] if r.text else r.text): r.predicted for r in got}
    assert by[(3, "vile word")] == 1 and by[(2, "calm word")] == 0 and by[(None, None)] == 0 and by[(100, "")] == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, none).collect())
    empty = spark.createDataFrame([], schema)
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []
