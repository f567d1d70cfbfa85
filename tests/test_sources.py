"""Sources and state: guarded calls, details, sheets, reviews of all sources, decisions in batch and as a stream."""

import json
import random
import zipfile

import pytest

from cairn import vocab
from cairn.operators import checks, records
from cairn.sources import files, rest
from cairn.streaming import decisions


def test_guarded_calls_over_runs(spark, tmp_path):
    marks = tmp_path / "made"
    marks.mkdir()

    def call(request):
        (marks / f"{request['source']}-{request['n']}").write_text("")
        if request["n"] % 10 in (7, 8, 9) and request["source"] != "calm":
            raise ValueError(f"serviceKey=abc refused {request['n']}")
        return f"ok {request['n']}"

    rows = [("calm", n) for n in range(40)] + [("hot", n) for n in range(3000)] + [("few", 1)]
    df = spark.createDataFrame(rows, "source string, n long").repartition(6)
    got, state = rest.guarded(df, call, "source", ["n"], budget=30)
    by = {(r.source, r.n): (r.status, r.answer, r.error) for r in got.collect()}
    assert len(by) == len(rows) and got.count() == len(rows)  # read twice, called once
    assert [by["hot", n][0] for n in range(12)] == ["ok"] * 7 + ["failed"] * 3 + ["stopped"] * 2 and by["hot", 2999] == ("stopped", None, "3 failures in a row")
    assert by["hot", 8][2] == "serviceKey=*** refused 8" and by["calm", 29][1] == "ok 29" and by["calm", 30] == ("stopped", None, "budget of 30 calls") and by["few", 1][0] == "ok"
    assert len(list(marks.iterdir())) == 10 + 30 + 1
    assert sorted(map(tuple, state.collect())) == [("calm", 30, 0), ("few", 1, 0), ("hot", 10, 3)]
    again, state = rest.guarded(df.where("n >= 30 or source = 'few'"), call, "source", ["n"], state, budget=32)
    by = {(r.source, r.n): r.status for r in again.collect()}
    assert by["few", 1] == "ok" and by["hot", 30] == "stopped" and [by["calm", n] for n in range(30, 34)] == ["ok", "ok", "stopped", "stopped"]
    assert sorted(map(tuple, state.collect())) == [("calm", 32, 0), ("few", 2, 0), ("hot", 10, 3)]


def test_details_are_fetched_once(spark, tmp_path):
    marks = tmp_path / "made"
    marks.mkdir()

    def fetch(keys):
        for k in keys:
            (marks / str(k)).touch(exist_ok=False)
        return {k: f"d{k}" for k in keys if k != 3}

    rows = spark.createDataFrame([(i, i % 5 if i % 6 else None) for i in range(60)], "id long, key long")
    cache = f"file://{tmp_path}/cache"
    for part in (rows.where("id < 3"), rows, rows, rows.limit(0)):
        got = rest.with_details(part, "key", fetch, cache, "long", batch=2).collect()
        assert all(r.detail == (None if r.key in (None, 3) else f"d{r.key}") for r in got) and len(got) == part.count()
    assert {p.name for p in marks.iterdir()} == {"0", "1", "2", "3", "4"}


def workbook(path, sheets):
    """A small workbook: shared and inline texts, numbers, truth values and gaps."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = sorted({v for rows in sheets.values() for r in rows for v in r if isinstance(v, str)})
    cell = lambda at, v: "" if v is None else f'<c r="{at}" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c r="{at}"><v>{v}</v></c>' if not isinstance(v, str) else f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>' if len(v) % 2 else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{v[:2]}</t></r><r><t>{v[2:]}</t></r></si>" for v in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{k}">' + "".join(cell(f"{chr(65 + j)}{k}", v) for j, v in enumerate(r)) + "</row>" for k, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_sheets_of_several_workbooks(spark, tmp_path):
    one = [["id", "name", "score", "ok"], [1, "가나다", 4.5, True], [None, None, None, None], [2, None, None, False]] + [[i, f"name {i}", None, None] for i in range(3, 2500)]
    workbook(tmp_path / "a.xlsx", {"Other": [["x"], ["y"]], "Reviews": one})
    workbook(tmp_path / "b.xlsx", {"Reviews": [["name", "id"], ["bee", 9999]]})
    got = {r.id: r for r in files.read_sheet(spark, f"file://{tmp_path}/*.xlsx", "Reviews").collect()}
    assert len(got) == 2500 and set(got["1"].asDict()) == {"id", "name", "score", "ok"}
    assert (got["1"].name, got["1"].score, got["1"].ok) == ("가나다", "4.5", "True") and (got["2"].name, got["2"].ok) == (None, "False") and got["9999"].name == "bee" and got["9999"].score is None
    with pytest.raises(Exception, match="no sheet 'None'"):
        files.read_sheet(spark, f"file://{tmp_path}/a.xlsx", "None").collect()


def found_in(data):
    if isinstance(data, list):
        return [x for x in data if isinstance(x, dict)]
    if not isinstance(data, dict):
        return []
    lists = [v for v in data.values() if isinstance(v, list) and v and isinstance(v[0], dict)]
    return [x for v in lists for x in v if isinstance(x, dict)] if lists else [data]


def test_records_in_by_hand(spark):
    texts = ['{"items":[{"a":1},3,{"a":2}]}', '{"items":[3,{"a":1}]}', '[{"a":1},[{"b":2}],4]', "[]", "{}", '{"a":[]}', "3", "broken {", None, '{"x":[{"a":1}],"y":[{"b":2},{"c":[{"d":1}]}],"z":1}', "[[1]]", "null"]
    got = {}
    for r in files.records_in(spark.createDataFrame(list(enumerate(texts)), "i int, js string"), "js").collect():
        got.setdefault(r.i, []).append(json.loads(r.record))
    for i, t in enumerate(texts):
        try:
            want = found_in(json.loads(t or "null"))
        except ValueError:
            want = []
        key = lambda x: json.dumps(x, sort_keys=True)
        assert sorted(got.get(i, []), key=key) == sorted(want, key=key), t


def test_review_records_by_hand(spark):
    reviews = [
        {"text": " fine ", "id": 5, "rating": 4, "language": "ko", "source_language": "en"}, {"review": "good", "review_id": "r1", "translation_status": "translated"}, "no object", {"text": ""}, {"content": "x", "publish_ts": "p", "date": "d", "language": "en", "source_language": "en"},
        {"text": 3, "body": "not used"}, {"text": [], "body": "b", "title": "t", "trip_type": "solo"}, {"body": "  "},
    ]
    df = spark.createDataFrame([("p1", "hotel", ["maps", "tour"], json.dumps(reviews)), ("p2", "hotel", ["tour"], None), ("p3", "hotel", ["tour"], "broken"), ("p4", "hotel", ["tour"], "{}")], "place_id string, category string, sources array<string>, reviews string")
    got = {r.review_id: r for r in records.review_records(df).collect()}
    assert set(got) == {"maps_5", "maps_r1", "p1#4", "p1#6"}
    assert (got["maps_5"].review, got["maps_5"].rating, got["maps_5"].translated, got["maps_5"].source) == ("fine", "4", True, "maps")
    assert got["maps_r1"].translated and not got["p1#4"].translated and got["p1#4"].published == "p" and (got["p1#6"].review, got["p1#6"].title, got["p1#6"].trip_type) == ("b", "t", "solo")
    assert not any(r.synthetic for r in got.values())


class Session:
    """The same decisions one by one."""

    def __init__(self, silver):
        self.silver, self.state = silver, {}

    def take(self, event):
        _, review_id, _, action, _, _, contexts, aspects = event
        if review_id not in self.silver:
            return
        if action == "approve":
            bad = any(c not in vocab.TRAVELER_CONTEXTS for c in contexts) or any(a[1] not in vocab.ATTRIBUTES["hotel"].get(a[0], []) or a[2] not in vocab.SENTIMENTS or a[3] not in self.silver[review_id][2] for a in aspects)
            if bad:
                return
        if action in ("approve", "discard", "reset"):
            self.state[review_id] = event


def test_decisions_as_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    kind = "category string, review string, traveler_context array<string>, aspects array<struct<category:string,attribute:string,sentiment:string,evidence:string>>"
    drafts = [(i, "hotel", "방이 깨끗해요", ["solo"], [("cleanliness", "clean", "positive", "깨끗")]) for i in range(20)]
    silver = spark.createDataFrame(drafts, f"review_id long, {kind}")
    labels = [(["solo"], [("cleanliness", "clean", "positive", "깨끗")]), ([], []), (["aliens"], []), ([], [("cleanliness", "odd", "positive", "깨끗")]), ([], [("cleanliness", "dirty", "negative", "더러")])]
    log = [(k, rng.randrange(22), k // 3, rng.choice(["approve", "approve", "discard", "reset", "odd"]), f"r{k % 2}", f"n{k}", *rng.choice(labels)) for k in range(200)]
    schema = f"event_id long, review_id long, at long, action string, reviewer string, note string, {kind.split(', ', 2)[2]}"
    v = checks.Vocabulary(vocab.ATTRIBUTES)
    own = Session({d[0]: d for d in drafts})
    for event in log:
        own.take(event)
    whole = spark.createDataFrame(log, schema)
    state = decisions.latest(decisions.judged(whole, silver, v))
    assert {r.review_id: r.event_id for r in state.collect()} == {k: e[0] for k, e in own.state.items()}
    names = {"approve": "gold", "discard": "discarded"}
    assert {r.review_id: r.status for r in decisions.statuses(state, silver).collect()} == {i: names.get(own.state[i][3], "pending") if i in own.state else "pending" for i in range(20)}
    gold = {r.review_id: r for r in decisions.gold(state, silver).collect()}
    for i, e in own.state.items():
        assert (i in gold) == (e[3] == "approve")
        if i in gold:
            assert gold[i].decision.edited == ((e[6], e[7]) != (["solo"], drafts[0][4])) and gold[i].decision.note == e[5] and gold[i].silver_label.traveler_context == ["solo"]
    out = {r.review_id: r.decision.note for r in decisions.discarded(state, silver).collect()}
    assert out == {i: e[5] for i, e in own.state.items() if e[3] == "discard"}
    shuffled = log[:]
    rng.shuffle(shuffled)  # what comes late counts by its time
    for k in range(0, 200, 70):
        spark.createDataFrame(shuffled[k : k + 70], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        decisions.run_decisions(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), silver, v, f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint")
    last = sorted(p.name for p in (tmp_path / "state").iterdir())[-1]
    assert {r.review_id: r.event_id for r in spark.read.parquet(f"{tmp_path}/state/{last}").collect()} == {k: e[0] for k, e in own.state.items()}
