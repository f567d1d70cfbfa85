import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cairn.llm import fingerprints


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        h = len(t) // 2
        out.append((d, t, t[: len(t) - h] + nxt[:h], nxt))
    return out


def check(rows, got):
    want = expected(rows)
    assert sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e, _ in want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got)
    return want


def test_against_true_likeness(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r for r in fingerprints.op3_query(spark, d).collect()}
    errors = []
    prints = {}
    for doc, text, edited, nxt in check(rows, got.values()):
        r = got[doc]
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, nxt)]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) in (0, 256)
    assert len(set(prints.values())) >= len(prints) - 2
    assert max(map(abs, errors)) < 0.2 and sum(e * e for e in errors) / len(errors) < 0.03**2
    assert abs(sum(errors) / len(errors)) < 0.005


@pytest.mark.parametrize("a_range", [2, 3, 1000])
def test_order_ties_nulls_and_long_texts(spark, tmp_path, monkeypatch, a_range):
    monkeypatch.setattr(fingerprints, "DOCS_A_RANGE", a_range)
    rows = [(5, "b b c d e f"), (5, "a"), (9, ""), (9, None), (1, "one two\tthree four five six Seven"), (None, "lost words of no id at all"), (None, None), (12, "w " * 30000), (12, "w " * 30000), (3, "👍 é " * 9), (7, "\n \t"), (-4, "x y")]
    docs = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, guest int, own string")
    path = str(tmp_path / "d")
    docs.write.parquet(f"{path}/documents.parquet")
    got = fingerprints.op3_query(spark, path).collect()
    check([(d, t or "") for d, t in rows], got)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id == 7:
            assert r.fingerprint == ""


def test_empty_and_one(spark, tmp_path):
    for n in (0, 1):
        path = str(tmp_path / str(n))
        spark.createDataFrame([(4, "abc def")][:n], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        got = fingerprints.op3_query(spark, path).collect()
        assert len(got) == n and all(r.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and r.near_next == 1 for r in got)


def test_no_python_in_the_plan(spark):
    plan = fingerprints.op3_query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
