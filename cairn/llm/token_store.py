"""Operator 1, token-ID output: one zstandard frame per document under a shared dictionary.

File format (little endian), one file per range of doc_id:

    magic b"CTOK0001" | frames, back to back | index | footer
    index   doc_id int64[n] | doc_id is known uint8[n] | n_tokens uint32[n] | frame offset uint64[n + 1]
    footer  sha256 of the dictionary (32) | width of an id in bytes uint32 | index offset uint64 | n uint64 | magic

A frame holds one document's ids, `width` bytes each (2 where the vocabulary allows it), compressed on its own, so a
short document is read by two small seeks (footer with index, then its frame). The dictionary lies beside the files as
`dict-<sha256>.zdict`; a reader refuses frames whose footer names another one.

The table is dealt to at most MAX_RANGES ranges of doc_id, one task each, and a task begins a new file every
DOCS_A_FILE documents; where one doc_id (or null) fills several ranges, a hash of the text deals its rows among them.

Edge cases: null text counts as empty (only the end id is stored); strings of added tokens in a text are these tokens, as
the library has it; a null doc_id sorts first; repeated doc_ids are all kept, in an order of their range, then their
token checksum; an empty table gives no file and no row; very long texts are
encoded whole and are one frame each; rows that tie in doc_id and checksum hold the same ids; further columns are ignored.
Tasks write under a name of their own and rename, so a task that runs twice leaves the same files.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.memory import tidied
from cairn.session import scratch

MAGIC = b"CTOK0001"
FOOTER = 32 + 4 + 8 + 8 + len(MAGIC)
#: Words that a worker keeps with their ids; beyond, new ones are encoded batch by batch.
CACHE_WORDS = 700_000
#: The dictionary is trained on at most this many documents, and on at most this many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2_000, 8_192, 112 * 1024
DOCS_A_FILE, MAX_RANGES = 12_288, 32_768
#: Normalisers that work character by character or on neighbours within a word, and pre-tokenizers that split at white space.
LOCAL_NORMALISERS = frozenset({"NFC", "NFD", "Lowercase", "StripAccents"})
SPLITTERS = frozenset({"WhitespaceSplit", "Whitespace", "BertPreTokenizer"})
#: Patterns of a Split pre-tokenizer, none of whose matches can hold white space, that drop all between the matches.
SPLIT_PATTERNS = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})

MANIFEST = "file string, bucket long, number long, n_docs long, n_tokens long, first_id long, last_id long"
NULL_ID = -(1 << 63)

_encoders: dict[str, "WordEncoder"] = {}


def splits_at_spaces(tokenizer: dict) -> bool:
    """Whether a tokenizer (as parsed JSON) is known to drop white space and never to merge across it."""
    normaliser = tokenizer.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for n in normaliser.get("normalizers", [normaliser]):
        spaces = n["type"] == "Replace" and n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " "
        if n["type"] not in LOCAL_NORMALISERS and not spaces:
            return False
    splitter = tokenizer.get("pre_tokenizer") or {"type": None}
    first = (splitter.get("pretokenizers") or [splitter])[0]
    if first["type"] == "Split":
        return first["pattern"].get("Regex") in SPLIT_PATTERNS and first["behavior"] == "Removed" and first["invert"]
    return first["type"] in SPLITTERS


class WordEncoder:
    """Ids of whole texts by the tokenizers library, computed once per distinct space-separated piece.

    That is done where the tokenizer's settings say that it splits at white space (splits_at_spaces), and for texts
    without an added token (as `<|endoftext|>`); the library gets the others whole. Letters followed by one run of ASCII
    punctuation are looked up as two pieces, where the pre-tokenizer separates these too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        added = settings.get("added_tokens") or []
        self.added = frozenset(t["id"] for t in added)
        # an added token of letters might be met where pieces are joined or cut
        self.by_word = splits_at_spaces(settings) and not any(not t["content"].strip() or t["content"].split() != [t["content"]] or t["content"].isalpha() for t in added)
        splitter = settings.get("pre_tokenizer") or {}
        first = (splitter.get("pretokenizers") or [splitter])[0]
        self.by_stem = first.get("type") in ("Split", "Whitespace", "BertPreTokenizer") and not any(re.fullmatch(r"[^\W\d_]*[.,;:!?]*", t["content"]) for t in added)
        vocab = self.tok.get_vocab()
        self.width = 2 if max(vocab.values(), default=0) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self.cache: dict[str, bytes] = {"": b""}
        self.with_added: set[str] = set()  # pieces that hold an added token: the few texts with one are encoded whole

    def packed(self, ids) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.tok.encode(text, add_special_tokens=False).ids)

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of the words, and of the parts that they were split into."""
        known, new = self.cache, {}
        simple, rest, joined = [], [], {}
        for w in words:
            if w.isalpha() and w.lower().isalpha():
                simple.append(w)
                continue
            stem = w.rstrip(".,;:!?") if self.by_stem else ""
            if stem and stem.isalpha() and stem.lower().isalpha():
                joined[w] = stem
                if stem not in known:
                    simple.append(stem)
            else:
                rest.append(w)
        simple = list(dict.fromkeys(simple))
        for lo in range(0, len(simple), 20_000):
            part = simple[lo : lo + 20_000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a tokenizer without word ends: each word by itself
                rest += part
                continue
            raw, at = self.packed(ids), [0, *(stops * self.width).tolist()]
            for w, a, b in zip(part, at, at[1:]):
                new[w] = raw[a:b]
        for w in {*rest, *(w[len(stem) :] for w, stem in joined.items())} - new.keys():
            if (had := known.get(w)) is None:
                ids = self.tok.encode(w, add_special_tokens=False).ids
                had = self.packed(ids)
                if not self.added.isdisjoint(ids):
                    self.with_added.add(w)
            new[w] = had
        for w, stem in joined.items():
            new[w] = (known.get(stem) or new[stem]) + new[w[len(stem) :]]
            if w[len(stem) :] in self.with_added:
                self.with_added.add(w)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.cache.get, p)) for p in pieces]
        holes = [list(compress(range(len(f)), map(is_, f, repeat(None)))) for f in found]
        if missing := {p[i] for p, h in zip(pieces, holes) for i in h}:
            new = self._learn(missing)
            for p, f, h in zip(pieces, found, holes):
                for i in h:
                    f[i] = new[p[i]]
            if len(self.cache) < CACHE_WORDS:
                self.cache.update(new)
        if not self.with_added:
            return [b"".join(f) for f in found]
        out = [b"".join(f) if self.with_added.isdisjoint(p) else self.whole(t) for t, p, f in zip(texts, pieces, found)]
        if len(self.with_added) > 10_000:  # what is not kept is learnt anew
            self.with_added &= self.cache.keys()
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _batches(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _texts(column) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained where there is enough to train on, else the samples themselves as raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _as_dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from at most SAMPLE_DOCS documents, picked by a hash of doc_id."""
    n = docs.count()
    step = max(1, n // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text").limit(SAMPLE_DOCS)

    def run(it):
        enc = encoder(tokenizer_path)
        for b in it:
            yield pa.RecordBatch.from_pydict({"ids": [x[:SAMPLE_BYTES] for x in enc.encode(_texts(b.column("text")))]}, schema=pa.schema([("ids", pa.binary())]))

    return _dictionary([r.ids for r in some.mapInArrow(tidied(run), "ids binary").collect() if r.ids])


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Inner bounds of doc_id that cut the table into about `ranges` equal ranges; a doc_id that fills several repeats."""
    if ranges < 2:
        return []
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("i"))
    return sorted(int(c) for c in ids.approxQuantile("i", [i / ranges for i in range(1, ranges)], 0.1 / ranges))


def _range_of(ids: np.ndarray, texts: list[str], bounds: np.ndarray) -> np.ndarray:
    """The range of each document; a checksum of the text deals those of a doc_id that several bounds name."""
    first, last = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    for k in np.flatnonzero(last - first > 1).tolist():
        first[k] += zlib.crc32(texts[k].encode("utf-8", "surrogatepass")) % int(last[k] - first[k] + 1)
    return first.astype(np.int32)


def write_token_store(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, docs_a_file: int = DOCS_A_FILE, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Encode `docs` (doc_id, text), write the files under `out` and return the manifest, one row per file."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = train_dictionary(docs, tokenizer_path)
    digest = hashlib.sha256(raw).hexdigest()
    fs, root = pafs.FileSystem.from_uri(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dict-{digest}.zdict") as f:
        f.write(raw)
    bounds = np.array(_bounds(docs, min(max_ranges, -(-docs.count() // docs_a_file))), dtype=np.int64)
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("width", pa.int32()), ("frame", pa.binary())])

    def encode(it):
        enc = encoder(tokenizer_path)
        zip_ = zstandard.ZstdCompressor(level=3, dict_data=_as_dict(raw))
        end = enc.packed([end_id])
        for b in _batches(it):
            texts = _texts(b.column("text"))
            ids = [x + end for x in enc.encode(texts)]
            doc = b.column("doc_id")
            bucket = _range_of(np.asarray(doc.fill_null(NULL_ID)), texts, bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), doc, pa.array([len(x) // enc.width for x in ids]), pa.array([zlib.crc32(x) for x in ids]), pa.array([enc.width] * len(ids), pa.int32()), pa.array([zip_.compress(x) for x in ids], pa.binary())],
                schema=schema,
            )

    def write(it):
        fs, root = pafs.FileSystem.from_uri(out)
        done, state, bucket = [], None, None

        def close():
            name, tmp, sink, ids, known, counts, offsets, width = state
            sink.write(np.array(ids, dtype="<i8").tobytes() + np.array(known, dtype="u1").tobytes() + np.array(counts, dtype="<u4").tobytes() + np.array(offsets, dtype="<u8").tobytes())
            sink.write(bytes.fromhex(digest) + np.array([width], dtype="<u4").tobytes() + np.array([offsets[-1], len(ids)], dtype="<u8").tobytes() + MAGIC)
            sink.close()
            fs.move(tmp, f"{root}/{name}")
            some = [i for i, k in zip(ids, known) if k]  # in order
            done.append((name, bucket, number, len(ids), int(sum(counts)), some[0] if some else None, some[-1] if some else None))

        for b in it:
            for k, doc, count, width, frame in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "n_tokens", "width", "frame"))):
                if state is None or k != bucket or len(state[3]) >= docs_a_file:
                    if state is not None:
                        close()
                    bucket, number = k, number + 1 if k == bucket else 0
                    name = f"part-{k:06d}-{number:06d}.tok"
                    tmp = f"{root}/.{name}.{uuid.uuid4().hex}"
                    state = (name, tmp, fs.open_output_stream(tmp), [], [], [], [len(MAGIC)], width)
                    state[2].write(MAGIC)
                state[2].write(frame)
                state[3].append(doc or 0)
                state[4].append(doc is not None)
                state[5].append(count)
                state[6].append(state[6][-1] + len(frame))
        if state is not None:
            close()
        cols = list(zip(*done)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["file", "bucket", "number", "n_docs", "n_tokens", "first_id", "last_id"])

    coded = docs.mapInArrow(tidied(encode), "bucket int, doc_id long, n_tokens long, crc long, width int, frame binary")
    dealt = coded.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "crc", "n_tokens")
    dealt.mapInArrow(tidied(write), MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


class Reader:
    """Access to the documents of one file of a store."""

    def __init__(self, fs, root: str, name: str):
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        foot = self.file.read_at(FOOTER, size - FOOTER)
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{name} is not a token file")
        digest = foot[:32].hex()
        self.width = int(np.frombuffer(foot, "<u4", 1, 32)[0])
        at, n = (int(x) for x in np.frombuffer(foot, "<u8", 2, 36))
        raw = self.file.read_at(size - FOOTER - at, at)
        self.doc_id = np.frombuffer(raw, "<i8", n)
        self.known = np.frombuffer(raw, "u1", n, 8 * n).astype(bool)
        self.n_tokens = np.frombuffer(raw, "<u4", n, 9 * n)
        self.offset = np.frombuffer(raw[13 * n :], "<u8", n + 1)
        with fs.open_input_stream(f"{root}/dict-{digest}.zdict") as f:
            words = f.read()
        if hashlib.sha256(words).hexdigest() != digest:
            raise ValueError(f"the dictionary of {name} has changed")
        self.unzip = zstandard.ZstdDecompressor(dict_data=_as_dict(words))

    def ids(self, lo: int, hi: int | None = None) -> Iterator[np.ndarray]:
        """The ids of documents lo to hi (by position), with one read."""
        hi = lo + 1 if hi is None else hi
        base = int(self.offset[lo])
        raw = self.file.read_at(int(self.offset[hi]) - base, base)
        for i in range(lo, hi):
            frame = raw[int(self.offset[i]) - base : int(self.offset[i + 1]) - base]
            yield np.frombuffer(self.unzip.decompress(frame), f"<u{self.width}")


def read_token_store(spark: SparkSession, out: str) -> DataFrame:
    """Every document of the store: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = manifest.groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens")).select("bucket", before(Window.orderBy("bucket")).alias("of_range"))  # MAX_RANGES rows at most
    files = manifest.withColumn("of_file", before(Window.partitionBy("bucket").orderBy("number"))).join(F.broadcast(ranges), "bucket").withColumn("base", F.col("of_range") + F.col("of_file"))

    def read(it):
        fs, root = pafs.FileSystem.from_uri(out)
        for b in it:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                r = Reader(fs, root, name)
                starts = base + np.concatenate([[0], np.cumsum(r.n_tokens.astype(np.int64))])
                for lo in range(0, len(r.doc_id), 1024):
                    hi = min(lo + 1024, len(r.doc_id))
                    ids = list(r.ids(lo, hi))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_id[lo:hi].astype(np.int64), mask=~r.known[lo:hi]), pa.array(starts[lo:hi]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return files.repartition(n).mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, out: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document, by the manifest and the index of its file; None where no file has it."""
    named = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    fs, root = pafs.FileSystem.from_uri(out)
    for name in [r.file for r in named.orderBy("bucket", "number").limit(1).collect()]:
        r = Reader(fs, root, name)
        if len(at := np.flatnonzero((r.doc_id == doc_id) & r.known)):
            return next(r.ids(int(at[0])))
    return None


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scratch(spark, "tokens")
    write_token_store(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_store(spark, out)
