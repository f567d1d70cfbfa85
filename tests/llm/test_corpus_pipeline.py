import re

import corpus_pipeline
from cairn.llm import decontamination, secret_scan, sentencepiece_codec, toxicity
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secret_scan import base
from tests.llm.test_sentencepiece_codec import REF

D = "/root/testdata/sf0.01"


def redacted(text, spans):
    out, at = "", 0
    for start, stop in sorted(spans):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, stop)
    return out + text[at:]


def test_run_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [len(rows), len({r.text for r in rows.values()})] == [1000, 927]
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    of = model.scorer()
    rows = {d: r for d, r in rows.items() if of(r.text) < 0.5}
    first = {d for d, _, c, _ in brute([(d, r.text) for d, r in rows.items()]) if d == c}
    rows = {d: r for d, r in rows.items() if d in first}
    items = [decontamination.words_of(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 8]) for w in items for k in range(len(w) - 7)}
    rows = {d: r for d, r in rows.items() if not any(tuple(w[k : k + 8]) in grams for w in [decontamination.words_of(r.text)] for k in range(len(w) - 7))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    assert set(got) == set(rows) and 600 < len(got) < 927
    for d, r in got.items():
        spans = [tuple(map(int, s.split(":")[1:])) for s in base(rows[d].text)]
        assert r.text == redacted(rows[d].text, spans), d
        assert r.n_chars == len(r.text) and r.ids == REF.encode(r.text) and r.parity and (r.lang, r.source) == (rows[d].lang, rows[d].source)


def test_stages_on_odd_rows(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, None, None, None, None), (3, None, None, None, None), (None, text + " token = abcdef123", None, None, None), (4, "", "", "", 0), (5, "api_key: 'zzzzzzz' and 👍 token=abcdef" + " word" * 50000, "x", "y", 9)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "none of the documents has this text in it at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    want = [("1", text), ("3", ""), ("3", ""), ("None", text), ("4", ""), ("5", "[SECRET]' and 👍 [SECRET] word word")]
    assert sorted((str(r.doc_id), (r.text or "")[:30]) for r in got) == sorted((d, t[:30]) for d, t in want)
    docs.limit(0).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []


def test_a_clean_row_stays_beside_a_leaking_one(spark, tmp_path):
    item = "which of the nine rivers of the old kingdom of varn flows north past the tower of salt"
    rows = [(1, f"some words before {item} and after"), (1, "a clean text of the same id with nothing to hide"), (None, item), (None, "another clean text"), (2, None)]
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.drop_leaks(spark, docs, d).collect()))) == sorted(map(str, (rows[1], rows[3], rows[4])))


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontamination", "secrets", "sentencepiece"]


def test_columns_of_any_name_stay(spark, tmp_path):
    """Names that operators use themselves, through each stage and the whole run."""
    names = "score predicted found _text _runs _base _row _ref _th first n_shingles key part fold kept_0 item_id th ref".split() + ["a.b", "back`tick"]
    text = "one two three four five six seven eight nine ten eleven twelve number"
    item = "which of the nine rivers of the old kingdom of varn flows north past the tower of salt"
    rows = [(i, f"{text} {i}" if i % 2 else f"{chr(97 + i)} token=abcdef123", *[f"{n}{i}" for n in names]) for i in range(6)] + [(None, item, *names)]
    quoted = [f"`{n.replace('`', '``')}`" for n in ("doc_id", "text", *names)]
    docs = spark.createDataFrame(rows, f"{quoted[0]} long, {', '.join(q + ' string' for q in quoted[1:])}")
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    of = {r[0]: r[2:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert len(got) >= 4 and all(tuple(r)[2:] == of[r.doc_id] for r in got), name
    got = corpus_pipeline.run(spark, d).collect()
    assert [r.asDict().keys() for r in got][0] == {*docs.columns, "ids", "parity", "round_trip"} and {r.doc_id for r in got} == {0, 1, 2, 4}
    assert all(tuple(r)[2 : 2 + len(names)] == of[r.doc_id] for r in got)
