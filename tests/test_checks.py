"""Rules of labels against plain Python, on labels made at random."""

import json
import random
import re

from pyspark.sql import functions as F

from cairn import vocab
from cairn.operators import checks, labels

KIND = "review_id long, category string, review string, traveler_context array<string>, aspects array<struct<category:string,attribute:string,sentiment:string,evidence:string>>"


def made(n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        category = rng.choice([*vocab.CATEGORIES, "museum"])
        review = rng.choice(["방이 정말 깨끗해요. 주차도 편해요!", "회가 신선했고 양도 많았어요~", ""])
        aspects = []
        for _ in range(rng.randrange(4)):
            known = rng.choice(list(vocab.ATTRIBUTES))
            name = rng.choice(list(vocab.ATTRIBUTES[known]))
            value = rng.choice([rng.choice(vocab.ATTRIBUTES[known][name]), "odd", None])
            aspects.append((rng.choice([name, name, name, None]), value, rng.choice(["positive", "negative", "odd", None]), rng.choice([review[:6], review[3:9], "정말 깨끗해요.", "없는 말", None, ""])))
        rows.append((i, category, review, rng.choice([None, [], ["solo"], ["solo", "aliens", None]]), rng.choice([aspects, aspects, aspects, None])))
    return rows


def allowed(category, name):
    return vocab.ATTRIBUTES.get(category, {}).get(name)


def text(*values):
    return "/".join("null" if v is None else v for v in values)


def test_problems_by_hand(spark):
    rows = made()
    df, v = spark.createDataFrame(rows, KIND), checks.Vocabulary(vocab.ATTRIBUTES)
    gold = {r.review_id: r.problems for r in checks.gold_problems(df, v).collect()}
    draft = {r.review_id: r.problems for r in checks.draft_problems(df, v).collect()}
    valid = {r.review_id: r.schema_valid for r in checks.schema_valid(df, v).collect()}
    counts = {r.problem: r.n for r in checks.schema_problems(df, v).collect()}
    seen = {}
    for i, category, review, contexts, aspects in rows:
        g = [f"context not allowed: {text(c)}" for c in contexts or [] if c not in vocab.TRAVELER_CONTEXTS]
        d, s = list(g), ["context not allowed" for _ in g]
        for name, value, sentiment, evidence in aspects or []:
            values = allowed(category, name)
            if values is None or value not in values:
                g.append(f"aspect or attribute not allowed: {text(name, value)}")
            if values is None:
                d.append(f"aspect of another category: {text(category, name)}")
                s.append(f"aspect not of category: {category}")
            elif value not in values:
                d.append(f"attribute not allowed: {text(name, value)}")
                s.append("attribute not of aspect")
            if sentiment not in vocab.SENTIMENTS:
                for found in (g, d):
                    found.append(f"sentiment not allowed: {text(sentiment)}")
                s.append("sentiment not allowed")
            if evidence is None or evidence not in review:
                for found in (g, d):
                    found.append(f"evidence not in review: {text(evidence)}")
        assert gold[i] == g and draft[i] == d, i
        good = contexts is not None and aspects is not None and all(c in vocab.TRAVELER_CONTEXTS for c in contexts)
        assert valid[i] == (good and all(n in vocab.ATTRIBUTES.get(category, {}) and a in allowed(category, n) and p in vocab.SENTIMENTS and e is not None for n, a, p, e in aspects)), i
        for m in s:
            seen[m] = seen.get(m, 0) + 1
    assert counts == seen


def test_finalized_by_hand(spark):
    rows = [(1, "hotel", "방이 정말 깨끗해요. 주차도 편해요!", ["solo"], [("room_condition", "clean", "positive", "정말 깨끗해요."), ("room_condition", "clean", "positive", "깨끗해요"), ("parking_experience", "easy", "positive", "주차도 편해요!")]),
            (2, "hotel", "방이 정말 깨끗해요", [], [("cleanliness", "clean", "positive", "깨끗해요")]), (3, "hotel", "x", None, [])]
    got = {r.review_id: r for r in checks.finalized(spark.createDataFrame(rows, KIND)).collect()}
    assert [tuple(a) for a in got[1].aspects] == [("room_condition", "clean", "positive", "깨끗해요"), ("parking_experience", "easy", "positive", "주차도 편해요")]
    assert [tuple(a) for a in got[1].label_raw.aspects] == rows[0][4] and got[1].label_raw.traveler_context == ["solo"]
    assert got[2].label_raw is None and got[3].label_raw is None and {r.split for r in got.values()} == {"test_real_gold"} and got[1].traveler_context == ["solo"]


def salvage(raw):
    """The rule in Python, for salvaged labels only."""
    start = raw.find('"aspects"')
    begin = raw.find("[", start) if start >= 0 else -1
    if begin < 0:
        return None
    m = re.search(r'"traveler_context"\s*:\s*(\[[^\]]*\])', raw)
    try:
        contexts = json.loads(m[1]) if m else []
    except ValueError:
        contexts = []
    at, found = begin + 1, []
    while (at := raw.find("{", at)) >= 0:
        try:
            value, at = json.JSONDecoder().raw_decode(raw, at)
        except ValueError:
            break
        found.append(value)
    return {"traveler_context": contexts, "aspects": found}


def test_salvage_by_brute_force(spark):
    rng = random.Random(6)
    values = ["가 {나} [다", 'q"uote\\', "l\nine", [1, {"y": "}"}], {"k": [{"z": []}]}, 1.5, None, True, "x" * 3000]
    texts = [None, "", "no", "[1]", '"aspects"', '"aspects" [', '{"traveler_context": [solo], "aspects": [{"a":1},', '{"traveler_context": ["solo"], "aspects": [{"a": 1}, 3, "x", {"b": 2}, {"c" 3}, {"d": 4}', '{"aspects": [{"a":1}], "traveler_context": ["solo"]', '{"aspects": [{"a":1}] , "meta": {"m": 2}', '{"aspects": [{"a": {"b": 1}, "c', " " + json.dumps({"aspects": []}) + "\n", '{"aspects": [{"raw\nbreak": 1}, {"a": "' + "\\n" * 500 + '"}', "{" * 5000 + '"aspects": [' + "{" * 5000]
    for _ in range(150):
        label = {"traveler_context": rng.choice([[], ["solo"], ["solo", "parents"]]), "aspects": [{rng.choice("abc"): rng.choice(values), "n": rng.randrange(9)} for _ in range(rng.randrange(4))]}
        whole = json.dumps(label, ensure_ascii=rng.random() < 0.5)
        texts.append(whole[: rng.randrange(len(whole) + 1)])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_output string")
    for r in labels.with_salvaged(df).collect():
        t = r.raw_output or ""
        try:
            whole = json.loads(t.strip())
        except ValueError:
            whole = None
        whole = whole if isinstance(whole, dict) else None
        want = whole if whole is not None else salvage(t)
        assert r.json_valid == (whole is not None) and r.salvaged == (whole is None and want is not None), t
        assert (json.loads(r.label_json) if r.label_json is not None else None) == want, t


def test_bytes_by_brute_force(spark):
    rng = random.Random(8)
    pieces = ["<0xEA><0xB0><0x80>", "<0xFF>", "<0xED><0xA0><0x80>", "<0x41>", "<0x4", "<", "a가", "\n", "<0xf0>", "<0xC3><0xA9>", "<<0x42>>", ""]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(300)), "<0x41>" * 20_000, "plain " * 50_000 + "<0xEA><0xB0><0x80>"]

    def decoded(m):
        try:
            return bytes(int(x, 16) for x in re.findall("<0x(..)>", m[0])).decode()
        except UnicodeDecodeError:
            return m[0]

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", labels.decoded_bytes(F.col("t")).alias("d")).collect()
    for r in got:
        assert r.d == (None if r.t is None else re.sub("(?:<0x[0-9A-F]{2}>)+", decoded, r.t)), r.t[:80]


def test_payload_keeps_nulls(spark):
    row = spark.range(1).select(checks.condition_payload(F.lit("solo"), F.lit(None).cast("string"), F.array(F.lit("sea")), F.array().cast("array<string>"), F.lit(None).cast("string")).alias("p")).first()
    assert row.p == '{"with":"solo","walk":null,"pri":["sea"],"avoid":[],"category":null}'


def test_missing_drafts(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "i long") for ids in ([1, 2, 3], [2, 3, 4]))
    assert sorted(map(tuple, checks.missing_drafts(a, b, "i").collect())) == [(1, "no draft"), (4, "no review")]
