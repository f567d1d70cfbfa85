import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cairn.llm import token_store
from cairn.session import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_matches_library(spark):
    rows = [
        (7, "The quick, brown fox's tail; it'll don't\nÉtoile ééà, xİ, 12345 a\u001cb c"),
        (3, None), (5, ""), (11, "word " * 20000), (2, "ﬁne … \t tab\r\n"), (9, "日本語 テスト 👍👍 <|endoftext "), (1, "don't,, we've'"), (None, "lost id"),
    ]
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, n_tokens int")
    out = scratch(spark, "t")
    m = token_store.write_token_store(docs, out, PATH, 1, docs_a_file=3)
    got = sorted(map(tuple, token_store.read_token_store(spark, out).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert m.count() > 1
    ids = token_store.fetch(spark, out, 7)
    assert ids.tolist() == [*Tokenizer.from_file(PATH).encode(rows[0][1], add_special_tokens=False).ids, 1]
    assert token_store.fetch(spark, out, 999) is None and token_store.fetch(spark, out, 8) is None


def test_empty_table(spark):
    out = scratch(spark, "t")
    token_store.write_token_store(spark.createDataFrame([], "doc_id long, text string"), out, PATH, 1)
    assert token_store.read_token_store(spark, out).collect() == []


def test_whole_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, token_store.op1_query(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == expected(rows)


def test_changed_dictionary_is_refused(spark, tmp_path):
    out = f"file://{tmp_path}/s"
    token_store.write_token_store(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), out, PATH, 1)
    for p in (tmp_path / "s").glob("dict-*"):
        p.write_bytes(b"other bytes")
    with pytest.raises(ValueError):
        token_store.fetch(spark, out, 1)


def test_strings_of_special_tokens(spark):
    d = "/root/testdata/sf0.001"
    made = ["a<|endoftext|>b", "<|startoftext|>", "x <|endoftext|>", "don't<|endoftext|>!,", "<|EndOfText|> A", "<|endoftext |> <| endoftext|>", "a\n<|endoftext|>\n<|startoftext|> b.", "word.<|endoftext|>"]
    texts = [r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    texts = made + [t[: len(t) // 2] + made[k % len(made)] + t[len(t) // 2 :] for k, t in enumerate(texts)]
    tok, enc = Tokenizer.from_file(PATH), token_store.WordEncoder(PATH)
    assert enc.by_word and tok.encode(made[0], add_special_tokens=False).ids == [320, 49407, 321]
    for lo in (0, 40):  # known pieces keep their mark
        part = texts[lo:]
        assert enc.encode(part) == [enc.packed(e.ids) for e in tok.encode_batch(part, add_special_tokens=False)]


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    byte = token_store.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "two  words\nand a third <|endoftext|> more"
    assert not byte.by_word and byte.encode([text]) == [byte.packed(byte.tok.encode(text, add_special_tokens=False).ids)]
    vocab = {w: i for i, w in enumerate(["[UNK]", "a", "b", "!", "PAD"])}
    tok = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tok.pre_tokenizer, tok.normalizer = pre_tokenizers.Whitespace(), normalizers.Lowercase()
    tok.add_special_tokens(["!"])
    tok.save(str(tmp_path / "t.json"))
    enc = token_store.WordEncoder(str(tmp_path / "t.json"))
    assert enc.by_word and not enc.by_stem
    tok.add_special_tokens(["PAD"])
    tok.save(str(tmp_path / "u.json"))
    other = token_store.WordEncoder(str(tmp_path / "u.json"))
    assert not other.by_word
    for e in (enc, other):
        texts = ["a b! a PAD b!", "b a", "PAD", "a!b"]
        assert e.encode(texts) == [e.packed(e.tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_document_id_of_many_ranges(spark):
    rows = [(k, f"text {k}") for k in range(40)] + [(17, f"copy {k}") for k in range(60)] + [(None, f"lost {k}") for k in range(30)]
    out = scratch(spark, "t")
    m = token_store.write_token_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), out, PATH, 1, docs_a_file=8, max_ranges=12)
    got = sorted(map(tuple, token_store.read_token_store(spark, out).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in expected(rows))
    files = m.collect()
    assert max(r.n_docs for r in files) <= 8 and len({r.bucket for r in files}) > 6
