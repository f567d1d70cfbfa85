"""Golden values and rules that SQL does not express."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn import vocab
from cairn.functions import exprs as X
from cairn.functions import requirements
from cairn.operators import curation, evaluation, labels, numbering, ranking
from cairn.sources import files, rest, sinks
from cairn.streaming import logs
from tests.test_scale import span_iou


@pytest.fixture(scope="module")
def fixture(spark):
    candidates = spark.createDataFrame([(31, "attraction"), (32, "restaurant"), (33, "attraction")], "place_id long, category string")
    rows = [(31, "walking_burden", 8, 0), (31, "slope_stairs", 6, 0), (32, "family_friendly", 8, 0), (32, "food_quality", 5, 0), (33, "walking_burden", 0, 8)]
    counts = spark.createDataFrame([(*r, 0) for r in rows], "place_id long, aspect string, pos long, neg long, neu long")
    totals = spark.createDataFrame([(31, 10), (32, 10), (33, 10)], "place_id long, reviews long")
    return candidates, ranking.scored_aspects(counts), totals


def ranks(spark, fixture, conditions, limit=10, category=None):
    weights = ranking.condition_weights(conditions)
    table = ranking.weight_table(spark, weights) if weights else None
    candidates = fixture[0] if category is None else fixture[0].where(F.col("category") == category)
    return [(r.place_id, r.fit) for r in ranking.score_places(candidates, fixture[1], fixture[2], table, limit).collect()]


def test_ranking_golden_values(spark, fixture):
    assert ranking.condition_weights({"walk": ["low"], "avoid": ["stairs"]}) == {"walking_burden": 4, "slope_stairs": 4}
    assert ranking.condition_weights({"pri": ["quiet"], "avoid": ["noise"]}) == {"noise_level": 3.5}
    assert ranking.condition_weights({"pri": ["culture"], "walk": ["ok"]}) == {}
    assert ranks(spark, fixture, {"with": ["parents"]}) == [(31, 88.8)]
    assert ranks(spark, fixture, {"with": ["kids"]}) == [(32, 90.0), (31, 88.8)]
    assert [p for p, _ in ranks(spark, fixture, {}, 1)] == [31]
    assert ranks(spark, (fixture[0].where("place_id = 33"), fixture[1].where("place_id = 33"), fixture[2]), {}) == []


def test_goodness(spark):
    rows = [(8, 0, 0, 90.0), (6, 0, 0, 87.5), (5, 0, 0, 85.7), (0, 8, 0, 10.0), (0, 0, 0, 50.0), (1, 1, 0, 50.0), (0, 0, 2, 50.0), (6, 5, 3, 53.1), (4, 2, 0, 62.5), (2, 1, 3, 56.2)]
    df = spark.createDataFrame(rows, "pos long, neg long, neu long, want double")
    for r in ranking.scored_aspects(df).collect():
        assert r.goodness == r.want


def keyword_states(text):
    """The rule, plainly: a mention is negated where the rest of its clause says so, a keyword where every mention is."""
    ends = [m.end() for m in re.finditer(requirements.CLAUSE_END, text)]
    out = []
    for keyword, (pattern, _) in vocab.KEYWORDS.items():
        places = [m.end() for m in re.finditer(pattern, text)]
        if places:
            out.append((keyword, all(re.search(requirements.NEGATION, text[at : next((e for e in ends if e > at), len(text))]) is not None for at in places)))
    return out


def test_keyword_states(spark):
    rng = random.Random(4)
    pieces = ["주차는", "주차", "필요 없고", "조용한 곳", "웨이팅", "상관없어요,", "근데", "바다", "보고", "쉬고", "싶은데", "신경 안 써도 돼요.", "아이", "지만", "중요하지 않아", "맛집", "빼도 돼", "\n", "회", "사진 찍지만", "면서"]
    texts = ["주차는 필요 없고 조용한 곳", "웨이팅 없는 곳", "주차 상관없어요, 근데 주차장이 넓으면", "", None] + [rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", requirements.keyword_states(F.col("t")).alias("s"), requirements.ignored_keywords(F.col("t")).alias("x")).collect()
    for r in got:
        want = keyword_states(r.t or "")
        assert [tuple(x) for x in r.s] == want and r.x == [k for k, n in want if n], r.t


def test_wish_weights(spark):
    wishes = spark.createDataFrame([(1, "부모님과 조용한 곳, 주차는 상관없어요"), (2, "아이와 계단 없이"), (3, "아무거나"), (4, None)], "id int, wish string")
    got = {(r.id, r.aspect): (r.weight, r.keywords) for r in requirements.wish_weights(wishes, "id", "wish").collect()}
    assert got[1, "noise_level"] == (3.5, ["조용함"]) and got[1, "walking_burden"] == (2.0, ["부모님"]) and (1, "parking_availability") not in got
    assert got[2, "walking_burden"] == (5.5, ["아이", "걷기 부담"]) and {i for i, _ in got} == {1, 2}
    only = requirements.wish_weights(wishes.where("id = 2"), "id", "wish", vocab.COMPANION_KEYWORDS).collect()
    assert {r.aspect for r in only} == set(vocab.KEYWORDS["아이"][1])


def test_char_iou_matches_python(spark):
    rows = [("abcdef", a, b) for a in ("abc", "cde", "x", "", None) for b in ("bcd", "abc", "x", "")]
    df = spark.createDataFrame(rows, "t string, a string, b string")
    for r in df.select("*", X.char_iou(F.col("a"), F.col("b"), F.col("t")).alias("v")).collect():
        assert r.v == pytest.approx(span_iou(r.a, r.b, r.t))


def test_quota_pick_is_sequential(spark):
    import hashlib

    rng = random.Random(9)
    rows = [(i, rng.choice(["hotel", "restaurant"]), "x" * rng.choice([10, 500]), rng.random() < 0.3) for i in range(200)]
    quotas, budget = {"hotel": 30, "restaurant": 40}, 25
    want, left = set(), budget
    for category, quota in quotas.items():
        empties, n = 0, 0
        longs = 0
        for i, c, text, empty in sorted((r for r in rows if r[1] == category), key=lambda r: (hashlib.sha256(f"s:{r[0]}".encode()).hexdigest(), r[0])):
            is_long = len(text) > 400
            longs += is_long
            if is_long and longs > left:
                continue
            empties += empty
            if empty and empties > round(quota * 0.2):
                continue
            if n < quota:
                n += 1
                want.add((i, is_long))
        left -= sum(1 for i, is_long in want if is_long and next(r for r in rows if r[0] == i)[1] == category)
    got = curation.quota_pick(spark.createDataFrame(rows, "review_id long, category string, review string, is_empty boolean"), quotas, budget, 0.2, "s").collect()
    assert {(r.review_id, len(r.review) > 400) for r in got} == want


def test_split_places_keeps_entities_together(spark):
    d = "/root/testdata/sf0.01"
    from cairn.plans import registry

    split = {r.place_id: r.split for r in registry.QUERIES["split_places"](spark, d).collect()}
    group = {r.place_id: r.group for r in registry.QUERIES["connected_groups"](spark, d).collect()}
    assert set(split) == set(group) and set(split.values()) == {"train", "val", "test"}
    assigned = {r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 8000").collect()}
    free: dict = {}
    for p, g in group.items():
        if p not in assigned:
            free.setdefault(g, set()).add(split[p])
    assert all(len(s) == 1 for s in free.values())


def test_labels(spark):
    assert {c: len(a) for c, a in vocab.ATTRIBUTES.items()} == {"hotel": 12, "restaurant": 13, "attraction": 11}
    row = spark.range(1).select(
        labels.normalize_evidence(F.lit("솔직히 , 방이 넓어요!! "), F.lit("방이 넓어요!! 그리고")).alias("a"), labels.normalize_evidence(F.lit("전체적으로 네."), F.lit("네")).alias("b"),
        labels.mentions_topic(F.lit("toilet_facilities"), F.lit("화장실이 깨끗")).alias("c"), labels.mentions_topic(F.lit("scenery"), F.lit("x")).alias("d"), labels.parking_value(F.lit("주차 불가 (인근 가능)")).alias("e"),
        labels.place_fact_holds(F.lit("place:parking=있음=3"), F.create_map(F.lit("parking"), F.lit("있음=3"))).alias("f"), labels.weather_value(F.lit("NA020300")).alias("g"),
    ).first()
    assert tuple(row) == ("방이 넓어요", "전체적으로 네.", True, True, "unavailable", True, "high")
    aspects = spark.createDataFrame([("r", "hotel", 0, "cleanliness", "clean", "positive", "방이 정말 깨끗해요.", "방이 정말 깨끗해요. 깨끗해요"), ("r", "hotel", 1, "cleanliness", "clean", "positive", "깨끗해요", "방이 정말 깨끗해요. 깨끗해요"), ("r", "hotel", 2, "room_condition", "worn", "negative", "얼룩이 많음", "얼룩이 많음")], "record string, kind string, pos int, category string, attribute string, sentiment string, evidence string, review string")
    assert [(r.category, r.attribute, r.evidence) for r in labels.clean_split(aspects).orderBy("pos").collect()] == [("cleanliness", "clean", "깨끗해요"), ("cleanliness", "dirty", "얼룩이 많음")]
    called = labels.map_rows(spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string"), lambda r: r["t"].upper() if r["i"] == 1 else 1 / 0, ["i", "t"], "out")
    assert [(r.out, r.out_error) for r in called.orderBy("i").collect()] == [("A", None), (None, "ZeroDivisionError: division by zero")]
    again = labels.map_rows(spark.createDataFrame([(1, "a")], "i int, t string"), lambda r: "<0xE2>", ["t"], "out", 2, lambda x: "<0x" not in x).first()
    assert (again.out, again.out_error) == (None, "refused")


def test_files(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"review_id": "1", "x": 1}\n\n{"review_id": "1", "x": 2}\n{"x": 3}\nbroken\n', encoding="utf-8")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("review_id", StringType()), StructField("x", LongType())])
    good, bad = files.read_jsonl_permissive(spark, str(lines), schema, "review_id")
    assert [tuple(r) for r in good.collect()] == [("1", 2)] and bad.count() == 2
    with pytest.raises(Exception, match="a.jsonl:5 JSON error"):
        files.read_jsonl_strict(spark, str(lines), "review_id string, x long").collect()
    assert files.read_jsonl(spark, str(tmp_path / "none"), schema, missing_ok=True).count() == 0
    for member, value in (("a", 1), ("b", 2)):
        (tmp_path / f"places_{member}.json").write_text(json.dumps([{"place_id": "p", "v": value}, {"place_id": member, "v": 0}]))
    got = files.read_places(spark, str(tmp_path / "places_*.json"), "place_id string, v int").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("b", 0), ("p", 2)]
    for name, encoding in (("u", "utf-8-sig"), ("k", "cp949")):
        (tmp_path / f"{name}.csv").write_bytes("이름,주소\n가나,\"다,라\"\n".encode(encoding))
        df = files.read_csv(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == ["이름", "주소"] and [tuple(r) for r in df.collect()] == [("가나", "다,라")]
    assert [tuple(r) for r in files.read_csv_positional(spark, str(tmp_path / "u.csv"), ["n", "a"]).collect()] == [("가나", "다,라")]
    assert files.file_with_prefix(["b.csv", "가.csv"], "가") == "가.csv"
    value, which = files.aliased(["title", "name"], ["name", "title", "other"])
    row = spark.createDataFrame([("t", "")], "title string, name string").select(value.alias("v"), which.alias("w")).first()
    assert tuple(row) == ("t", "title")


def fetch_pages(request, page):
    total = request["n"]
    return {"items": [{"id": k} for k in range((page - 1) * 100, min(page * 100, total))], "total": total}


def failing(request, page):
    raise OSError(f"no answer to serviceKey={request['apiKey']}&x=1")


def test_numbering_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("ab") if k % 7 else None, rng.choice([5, 5, 5, None, *range(60)])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r.id: (r.i, r.n) for r in numbering.number_by_value(df, ["g"], "v", "id", "i", "n").collect()}
    for g in ("a", "b", None):
        ids = [k for k, _, v in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))]
        assert [got[k] for k in ids] == [(i + 1, len(ids)) for i in range(len(ids))]
    got = {r.id: r.i for r in numbering.number_by_hash(df, ["g"], F.sha2(F.col("id").cast("string"), 256), "id", "i").collect()}
    for g in ("a", "b", None):
        ids = sorted((r[0] for r in rows if r[1] == g), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
        assert [got[k] for k in ids] == list(range(1, len(ids) + 1))
    with pytest.raises(ValueError):
        numbering.paired(df, df, most=10)


def test_paged_source_and_logs(spark, tmp_path):
    df = rest.paged(spark, fetch_pages, [{"n": 250}, {"n": 0}, {"n": 5000}])
    with pytest.raises(Exception, match="5000 items, of which 20 pages hold 2000"):
        df.collect()
    whole = rest.paged(spark, fetch_pages, [{"n": 250}, {"n": 0}, {"n": 5000}], max_pages=50)
    assert {json.loads(r.request)["n"]: r.n for r in whole.groupBy("request").agg(F.count(F.lit(1)).alias("n")).collect()} == {250: 250, 5000: 5000}
    with pytest.raises(Exception, match="101 items"):  # a single-shot source
        rest.paged(spark, fetch_pages, [{"n": 101}], max_pages=1).collect()
    with pytest.raises(Exception, match="page 1 failed 3 times: no answer to serviceKey=\\*\\*\\*&x=1"):
        rest.paged(spark, failing, [{"apiKey": "s3cret", "n": 1}], failures=3).collect()
    assert rest.items_of({"items": ""}) == rest.items_of({}) == [] and rest.items_of({"items": {"a": 1}}) == [{"a": 1}]
    assert [r.p for r in spark.createDataFrame([(0,), (100,), (101,), (9999,)], "t int").select(rest.pages_needed(F.col("t")).alias("p")).collect()] == [1, 1, 2, 100]
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert [logs.append_new(rows, path, "id"), logs.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), path, "id"), logs.append_new(rows, path, "id")] == [2, 1, 0]
    assert spark.read.parquet(path).count() == 3
    fixed = sinks.fixed_lines(spark.createDataFrame([("a<0x41>", "aA"), ("b<0xFF>", "b<0xFF>"), (None, None)], "t string, f string"), "t", "f").first()
    assert tuple(fixed) == (1, 1)


def test_resume_chain(spark):
    base = spark.createDataFrame([(1, "A"), (2, None)], "id int, v string")
    assert curation.pending(base, base.where("id = 1"), key="id").count() == 1
    assert {tuple(r) for r in curation.overlay(spark.createDataFrame([(1, "n")], "id int, s string"), spark.createDataFrame([(1, "o"), (2, "o")], "id int, s string"), "id", "s").collect()} == {(1, "n"), (2, "o")}
