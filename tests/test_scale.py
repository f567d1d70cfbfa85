"""Operators that must hold for groups of any size, against plain Python over the same rows."""

import hashlib
import json
import random
from collections import Counter

import pytest

from cairn.operators import curation, evaluation, selection
from cairn.sources import files

ASPECT = "array<struct<category:string,attribute:string,sentiment:string,evidence:string>>"


def span_iou(a, b, text):
    if not a or not b:
        return 0.0
    s, t = text.find(a), text.find(b)
    if min(s, t) < 0:
        return float(a == b)
    cover = set(range(s, s + len(a))), set(range(t, t + len(b)))
    return len(cover[0] & cover[1]) / (max(s + len(a), t + len(b)) - min(s, t))


def matches(gold, predicted, text, raw=None):
    """How many Gold labels find a prediction, in Gold order; the last of equally good ones."""
    free, tp = dict(enumerate(predicted)), 0
    for g in gold:
        said = [g[3]] if raw is None else [x[3] for x in gold + raw if x[:3] == g[:3] and x[3]]
        good = [(max((span_iou(s, p[3], text) for s in said), default=0.0), i) for i, p in free.items() if p[:3] == g[:3]]
        if good and max(good)[0] >= 0.5:
            del free[max(good)[1]]
            tp += 1
    return tp


def test_greedy_overlap_in_gold_order(spark):
    rng = random.Random(4)
    text = "the sea view was fine and the sea breeze was mild, the view cost"
    words = text.split()

    def aspects():
        out = []
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(words))
            evidence = rng.choice([" ".join(words[i : i + rng.randrange(1, 5)]), "", None, "not there", "sea"])
            out.append((rng.choice(["view", None]), rng.choice(["good", "poor"]), "positive", evidence))
        return out

    rows = [(i, rng.choice([text, text, "", None]), aspects(), aspects(), aspects()) for i in range(600)] + [(601, text, None, aspects(), None), (602, text, aspects(), None, [])]
    df = spark.createDataFrame(rows, f"review_id long, review string, gold {ASPECT}, predicted {ASPECT}, raw {ASPECT}")
    for raw in (None, "raw"):
        got = {r.review_id: (r.tp, r.fp, r.fn) for r in evaluation.greedy_overlap(df, raw=raw).collect()}
        for i, t, g, p, r in rows:
            tp = matches(g or [], p or [], t or "", None if raw is None else r or [])
            assert got[i] == (tp, len(p or []) - tp, len(g or []) - tp), (i, t, g, p)


@pytest.mark.parametrize("limit", [10, 100_000])
def test_values_at_with_one_key_in_nearly_all_rows(spark, limit, monkeypatch):
    monkeypatch.setattr(selection, "CUTS", 8)
    rng = random.Random(1)
    hot = [rng.choice([0.0, 1.5, rng.random(), rng.gauss(0, 1e6)]) for _ in range(4000)]
    groups = {"hot": hot, "same": [7.0] * 300, "one": [3.0], None: [float(i) for i in range(50)], "two": [2.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)], "k string, v double").repartition(5)
    places = {"p50": lambda n: selection.F.floor((n - 1) / 2), "p95": lambda n: selection.F.bround((n - 1) * 0.95), "first": lambda n: n * 0, "last": lambda n: n - 1, "beyond": lambda n: n}
    got = {r.k: r for r in selection.values_at(df, ["k"], "v", places, limit).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert (got[k].p50, got[k].p95, got[k].first, got[k].last, got[k].beyond) == (s[(n - 1) // 2], s[round((n - 1) * 0.95)], s[0], s[-1], None), k


def test_gap_audit_of_one_busy_key(spark):
    rng = random.Random(2)
    at = sorted(rng.randrange(10**6) for _ in range(500)) + [10**7]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(at)] + [("b", 5, 0)], "k string, s long, i long").selectExpr("k", "timestamp_seconds(s) AS ts", "i")
    got = evaluation.gap_audit(df.repartition(4), ["k"], "ts", ["i"], 3000).collect()
    gaps = sorted(b - a for a, b in zip(at, at[1:]))
    assert [(r.k, r.gaps, r.median_gap, r.slow) for r in got] == [("a", len(gaps), (gaps[249] + gaps[250]) / 2, sum(g > 3000 for g in gaps))]


def test_line_numbers_of_one_file_in_many_tasks(spark, tmp_path):
    lines = [json.dumps({"a": i, "b": "가" * (i % 40)}, ensure_ascii=False) if i % 13 else "" for i in range(4000)]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "y.jsonl").write_text('{"a": -1, "b": ""}', encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = files.numbered_lines(spark, f"file://{tmp_path}")
        assert numbered.rdd.getNumPartitions() > 20
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in numbered.collect()}
        assert got == {**{("x.jsonl", i + 1): v for i, v in enumerate(lines)}, ("y.jsonl", 1): '{"a": -1, "b": ""}'}
        rows = files.read_jsonl_strict(spark, f"file://{tmp_path}", "a long, b string").collect()
        assert sorted(r.a for r in rows) == sorted([-1, *(i for i in range(4000) if i % 13)])
        for k, broken in ((3001, "[1]"), (2001, '{"a": ')):
            path.write_text("\n".join([*lines[:k], broken, *lines[k + 1 :]]), encoding="utf-8")
            with pytest.raises(Exception, match=rf"x\.jsonl:{k + 1} JSON error"):
                files.read_jsonl_strict(spark, f"file://{tmp_path}", "a long, b string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def quota_by_hand(rows, quotas, budget, share):
    out = []
    for category, quota in quotas.items():
        own = sorted((r for r in rows if r[1] == category), key=lambda r: (hashlib.sha256(f"s:{r[0]}".encode()).hexdigest(), r[0]))
        longs, empties, picked = 0, 0, []
        for i, _, text, empty in own:
            long = text is not None and len(text) > 400
            longs += long
            if long and longs > budget:
                continue
            empties += bool(empty)
            if empty and empties > round(quota * share):
                continue
            picked.append((i, long))
        picked = picked[:quota]
        budget -= sum(long for _, long in picked)
        out += [i for i, _ in picked]
    return sorted(out)


def test_quota_pick_by_hand(spark):
    rng = random.Random(9)
    for budget, share in ((0, 0.0), (7, 0.2), (40, 0.5), (1000, 1.0)):
        rows = [(i, rng.choice(["a", "a", "a", "b", "c", "z"]), rng.choice(["x" * 500, "y", "w" * 300, None]), rng.choice([True, False, None])) for i in range(500)]
        df = spark.createDataFrame(rows, "review_id long, category string, review string, is_empty boolean").repartition(3)
        quotas = {"b": 30, "a": 60, "c": 500, "none": 4}
        assert sorted(r.review_id for r in curation.quota_pick(df, quotas, budget, share, "s").collect()) == quota_by_hand(rows, quotas, budget, share)


def test_drop_reasons_of_one_template_in_nearly_all_rows(spark):
    rows = [("c", "template text of many", i) for i in range(3000)] + [(None, "template text of many", 3000), ("c", "a text that is twice there", 1), ("c", "a text that is twice there", 2), ("c", "short", 5), ("c", None, 6), ("c", "a text that is once there", 7)]
    got = Counter((r.review, r.reason) for r in curation.drop_reasons(spark.createDataFrame(rows, "category string, review string, pos long")).collect())
    assert got == {("template text of many", "template"): 3000, ("template text of many", "category"): 1, ("a text that is twice there", None): 1, ("a text that is twice there", "duplicate"): 1, ("short", "short"): 1, (None, None): 1, ("a text that is once there", None): 1}


def test_round_robin_with_one_group_in_nearly_all_rows(spark):
    items = spark.createDataFrame([(i, "hot" if i % 50 else "cold") for i in range(3000)], "item long, g string")
    places = spark.createDataFrame([(f"p{i}", "hot" if i % 10 else "cold") for i in range(70)], "place string, g string")
    got = curation.round_robin(items, "item", places, "place", "g", "s", most=60).collect()
    assert len(got) == 3000 and len({r["item"] for r in got}) == 3000
    for g in ("hot", "cold"):
        used = Counter(r.place for r in got if r.g == g)
        assert max(used.values()) - min(used.values()) <= 1 and len(used) == (63 if g == "hot" else 7)
    with pytest.raises(ValueError, match="too many"):
        curation.round_robin(items, "item", places, "place", "g", "s", most=46)


@pytest.mark.parametrize("few", [True, False])
def test_texts_holding(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(curation, "KEYS", 3)
    texts = [(i, f"one two w{i % 7} three w{i % 5} four") for i in range(40)] + [(99, None), (98, "")]
    items = [(i, f"two w{i} three") for i in range(7)] + [(20, "one"), (21, "three w4"), (22, None), (23, "four five six")]
    got = sorted((r.doc_id, r.item_id) for r in curation.texts_holding(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"), "item_id", "item").collect())
    assert got == sorted((d, i) for d, t in texts for i, x in items if t and x and x in t)
