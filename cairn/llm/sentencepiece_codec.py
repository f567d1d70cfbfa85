"""Operator 9, SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; normaliser (precompiled character map, white space rules, metaspace marker, dummy
prefix), vocabulary with its scores (unigram, or merges ranked by score for BPE) and byte fallback are rebuilt as a
tokenizers.Tokenizer. Texts are encoded piece of white space by piece: where the vocabulary has no entry that goes on
after a space or holds a line feed, and the normaliser is the identity, no merge crosses these places, so each distinct
piece is encoded once, in multithreaded batches, and its ids are reused; other models get whole texts.

Control, unused and byte pieces never match text, whatever their names; user-defined ones are cut out first; what the
vocabulary does not have is spelled in byte pieces here.

Parity: every distinct piece (or whole text) is also encoded by the sentencepiece library when first met, and decoded
again; whole documents are compared as well where a checksum of the text says so, one in AUDIT. `parity` and `round_trip`
say for each document whether all of it agreed. Where it did not, the ids are those of the sentencepiece library.

Edge cases: null text counts as empty and has no ids; a null id array decodes to null; repeated rows are encoded alike;
texts may hold any character, U+0000 too; very long texts are encoded whole, piece by piece where the model allows it; there
are no ties; an empty table gives no row; columns named like the operator's own are replaced, others stay as they are.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.memory import tidied

# Field numbers and enum values of the public sentencepiece_model.proto.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
#: Pieces of a generation that a worker keeps with their ids; the one before is kept too, and what is met again moves on.
CACHE_PIECES = 300_000
#: One document in so many is compared with the reference as a whole, too.
AUDIT = 32
#: The same where ids are a stage of a pipeline, whose workers hold what other stages left, too.
PIPELINE_PIECES = 60_000
#: Documents that are encoded at once; the library's objects of a batch, which are large, go before the next.
BATCH_DOCS = 64
#: Threads of the tokenizers library in a worker: each holds memory of its own, and a worker has the cores of one task.
THREADS = 2

_codecs: dict[str, "Codec"] = {}


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of a protobuf message: int for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + n]
        at += n


def parse_model(raw: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(raw):
        if number == 1:
            got = dict(_fields(value))
            spec.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(_fields(value))
            spec.model_type = got.get(3, UNIGRAM)
            spec.byte_fallback = bool(got.get(35, 0))
        elif number == 3:
            got = dict(_fields(value))
            spec.charsmap = got.get(2, b"")
            spec.add_dummy_prefix = bool(got.get(3, 1))
            spec.remove_extra_whitespaces = bool(got.get(4, 1))
            spec.escape_whitespaces = bool(got.get(5, 1))
    return spec


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first: the order in which the model would join them."""
    score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)}
    rank = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    pairs = [(-score[p], rank[p], k, p[:k], p[k:]) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
    return [(a, b) for *_, a, b in sorted(pairs)]


def build_tokenizer(spec: Spec):
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), 0)
    if spec.model_type == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges_of(spec), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.model_type == UNIGRAM:
        # pieces that only ids name get names that no text has; unknown text is spelled in bytes by Codec
        model = models.Unigram([(p if kind in (NORMAL, USER_DEFINED) else f"\uffff{i}\uffff", s) for i, (p, s, kind) in enumerate(spec.pieces)], unk_id=unknown, byte_fallback=False)
    else:
        raise ValueError(f"model type {spec.model_type} is not supported")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", SPACE))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if own := [p for p, _, kind in spec.pieces if kind == USER_DEFINED]:
        tok.add_tokens([AddedToken(p, normalized=False, special=False) for p in own])
    tok.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tok


def _whole(part) -> bool:
    return type(part) is tuple


class Codec:
    """Encodes and decodes as the model does; the dummy prefix is written into the text before normalising."""

    def __init__(self, path: str, keep: int = CACHE_PIECES):
        import sentencepiece

        self.keep = keep

        with open(path, "rb") as f:
            self.spec = parse_model(f.read())
        self.tok = build_tokenizer(self.spec)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, kind in self.spec.pieces if kind in (NORMAL, USER_DEFINED))
        plain = not inner and not self.spec.charsmap and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces
        self.by_part = plain and self.spec.model_type == BPE and self.spec.add_dummy_prefix
        self.prefix = " " if self.spec.add_dummy_prefix else ""
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.wrong: set = set()  # parts without parity
        self.lossy: set = set()  # parts that do not come back
        said = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " \u2047 ".encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.bytes_of = [said.get(kind, lambda p: p.replace(SPACE, " ").encode())(p) for p, _, kind in self.spec.pieces]
        byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.spec.pieces) if kind == BYTE}
        self.unknown = next((i for i, p in enumerate(self.spec.pieces) if p[2] == UNKNOWN), 0)
        self.spelled = [byte_ids[k] for k in range(256)] if self.spec.byte_fallback and self.spec.model_type == UNIGRAM and len(byte_ids) == 256 else None
        # what comes before a part that no space leads: a line feed; the reference gets it so, and its ids are cut off
        self.front = len(self.reference.encode("\n", num_threads=1)) if self.by_part else 0

    def parts(self, text: str) -> list[str] | list[tuple[str]]:
        """The text in parts: a word for the word after one space (or the dummy prefix), a line feed and what follows it
        up to a space; texts with runs of spaces or markers, and all texts of other models, whole, as a tuple of one."""
        if not text:
            return []
        if not self.by_part or text[0] == " " or "  " in text or SPACE in text:
            return [(text,)]
        return text.replace("\n", " \n").split(" ")

    def _learn(self, parts: list) -> dict:
        # as the tokenizer gets them, and as the reference does, which puts the prefix itself
        own = [self.prefix + p[0] if _whole(p) else p if p[:1] == "\n" else " " + p for p in parts]
        ref = [p[0] if _whole(p) else p for p in parts]
        batch = self.tok.encode_batch if self.spelled else self.tok.encode_batch_fast  # the fast one leaves out the tokens' texts
        ids = [self._ids(e) for e in batch(own, add_special_tokens=False)]
        theirs = self.reference.encode(ref, num_threads=1)
        lone = self.tok.token_to_id(SPACE)
        new = {}
        for p, text, mine, other in zip(parts, own, ids, theirs):
            if p == "":
                other = [lone]
            elif not _whole(p) and p[:1] == "\n":
                other = other[self.front - 1 :]
            new[p] = np.array(other, dtype="<i4").tobytes()
            if mine != other:
                self.wrong.add(p)
            if self._text(other) != text:
                self.lossy.add(p)
        return new

    def _ids(self, encoding) -> list[int]:
        if self.spelled is None or self.unknown not in encoding.ids:
            return encoding.ids
        out = []
        for i, token in zip(encoding.ids, encoding.tokens):
            out += [i] if i != self.unknown else [self.spelled[x] for x in token.encode()]
        return out

    def forget(self) -> None:
        self.cache.clear()
        self.older.clear()
        self.wrong.clear()
        self.lossy.clear()

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text."""
        cut = [self.parts(t or "") for t in texts]
        found = [list(map(self.cache.get, c)) for c in cut]
        holes = [list(compress(range(len(f)), map(is_, f, repeat(None)))) for f in found]
        if missing := {c[i] for c, h in zip(cut, holes) for i in h}:
            new = {p: self.older[p] for p in missing if p in self.older}
            if fresh := [p for p in missing if p not in new]:
                new |= self._learn(fresh)
            for c, f, h in zip(cut, found, holes):
                for i in h:
                    f[i] = new[c[i]]
            self.cache.update((p, x) for p, x in new.items() if not _whole(p))
            if len(self.cache) > self.keep:
                self.older, self.cache = self.cache, {}
        out = [(np.frombuffer(b"".join(f), dtype="<i4"), not self.wrong or self.wrong.isdisjoint(c), not self.lossy or self.lossy.isdisjoint(c)) for c, f in zip(cut, found)]
        heard = [k for k, (t, c) in enumerate(zip(texts, cut)) if c and not _whole(c[0]) and zlib.crc32(t.encode()) % AUDIT == 0]
        for k, other in zip(heard, self.reference.encode([texts[k] for k in heard], num_threads=1) if heard else []):
            if out[k][0].tolist() != other:
                out[k] = (np.array(other, dtype="<i4"), False, out[k][2])
        for p in missing:  # whole texts are not worth keeping
            if _whole(p):
                self.wrong.discard(p)
                self.lossy.discard(p)
        return out

    def _text(self, ids: list[int]) -> str:
        """What the ids spell, with the prefix; bytes that are not UTF-8 are left to the tokenizer's own decoder."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            return self.tok.decoder.decode([self.spec.pieces[i][0] for i in ids])

    def decode(self, rows: list) -> list[str]:
        """Texts of id sequences."""
        return [self._text(ids.tolist() if isinstance(ids, np.ndarray) else ids).removeprefix(self.prefix) for ids in rows]


def codec(path: str, keep: int = CACHE_PIECES) -> Codec:
    if path not in _codecs:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read when the library first makes a batch
        _codecs[path] = Codec(path)
    _codecs[path].keep = keep
    return _codecs[path]


OWN = ("ids", "parity", "round_trip")


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """docs with ids, parity and round_trip."""
    keep = [c for c in docs.columns if c not in OWN]
    docs = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(it: Iterator[pa.RecordBatch]):
        c = codec(model, PIPELINE_PIECES)
        for whole in it:
            for lo in range(0, whole.num_rows, BATCH_DOCS):
                b = whole.slice(lo, BATCH_DOCS)
                got = c.encode(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([x for x, _, _ in got], pa.list_(pa.int32())), pa.array([p for _, p, _ in got]), pa.array([r for _, _, r in got])], names=[*b.schema.names, *OWN]
                )
        c.forget()  # the worker may go on with another stage's work

    return docs.mapInArrow(tidied(run), f"{schema}, ids array<int>, parity boolean, round_trip boolean")


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """rows with their ids decoded in a column `decoded`."""
    keep = [c for c in rows.columns if c != "decoded"]
    rows = rows.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(it: Iterator[pa.RecordBatch]):
        c = codec(model)
        for whole in it:
            for lo in range(0, whole.num_rows, BATCH_DOCS):
                b = whole.slice(lo, BATCH_DOCS)
                got = b.column(ids).to_pylist()
                texts = iter(c.decode([x for x in got if x is not None]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else next(texts) for x in got], pa.string())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(tidied(run), f"{schema}, decoded string")


def digest(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, of bytes spelled out, crc32 of the ids (int32, little endian), parity, and whether decoding gives the text back."""

    def run(it: Iterator[pa.RecordBatch]):
        c = codec(model)
        byte_ids = np.array([kind == BYTE for _, _, kind in c.spec.pieces])
        for whole in it:
            for lo in range(0, whole.num_rows, BATCH_DOCS):
                b = whole.slice(lo, BATCH_DOCS)
                texts = ["" if t is None else t for t in b.column("text").to_pylist()]
                got = c.encode(texts)
                back = c.decode([x for x, _, _ in got])
                arrays = [x for x, _, _ in got]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in arrays], pa.int64()), pa.array([int(byte_ids[x].sum()) for x in arrays], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in arrays], pa.int64()), pa.array([p for _, p, _ in got]), pa.array([t == d for t, d in zip(texts, back)])],
                    names=["doc_id", "n_ids", "n_bytes", "ids_crc32", "parity", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_ids long, n_bytes long, ids_crc32 long, parity boolean, round_trip boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
