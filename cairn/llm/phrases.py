"""Operator 12, phrase collocations by merged count-min sketches and an exact second count.

Texts are lower-cased (A to Z), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words. Tasks sketch the n-grams of
their rows (two rows of cells, hashed with the language), the sketches are added up slab by slab, and what remains of a
cell is one bit: whether its n-grams can be frequent. A sketch only overestimates, so every frequent n-gram passes. The
first sketch is of words and pairs, the second of longer n-grams all of whose pairs passed the first; then the survivors
alone are counted exactly, by their text, in buckets of a fixed size, and what is not frequent is left out. Cells grow with the words of the table, up
to 2 ** MAX_BITS a row, so the bits that tasks get are at most 4 * 2 ** MAX_BITS / 8 bytes; a table that needs more lets
more rare n-grams through to the exact count, with the same result.

Scores: floor(1000 * a * n / (l * r)) of the cut that scores lowest, in decimals of 38 digits. A phrase goes where a longer
candidate that holds it is as frequent; then the best of each language are ranked.

Edge cases: null texts count as empty, a null language as `und`; rows are counted as often as they stand, whatever their
doc_id; ties of cuts go to the shortest first part, ties of rank to the more frequent and then to the lesser phrase by
bytes, so ranks are unique; an empty table, or one without a frequent phrase, gives no row; very long texts are read whole,
in chunks that are cut between words, with an overlap, so that no task holds more than a chunk's words as objects; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.memory import tidied
from cairn.session import discard, materialize

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Cells of a row of the sketch, as a power of two; bytes of text for a cell; slabs of a row that are added up apart.
MIN_BITS, MAX_BITS, BYTES_PER_CELL, SLAB_BITS, ROWS = 16, 28, 48, 8, 2
#: A bucket of phrases is so many (a power of two) cells' worth of them, whatever the size of the table.
BUCKET_BITS = 14
#: Characters that are encoded at once, bytes that are split at once, words that are sorted at once.
BLOCK, CHUNK, WINDOW = 8 << 20, 4 << 20, 1 << 20
#: Hashes that a task holds before it sketches them, phrases that it holds with their counts.
HELD, PHRASES = 4 << 20, 400_000
#: Parts of a language's phrases that are ranked apart first.
PARTS = 64
#: Languages up to which their word counts are broadcast; more are shuffled.
BROADCAST_ROWS = 100_000
#: Odd multipliers of the hashes.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

BREAK = b"."  # no word, as a piece ends there
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
SKETCH = pa.schema([("slab", pa.int32()), ("steps", pa.binary()), ("far", pa.binary()), ("counts", pa.binary())])
COUNTED = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
PARTIAL = pa.schema([("bucket", pa.int32()), *((f.name, pa.list_(f.type)) for f in COUNTED)])


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(lang, texts) in blocks of bounded size; a longer text is a block of its own."""
    held, size = {}, 0
    for b in it:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= BLOCK:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _encode(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """The words of texts as numbers, 0 between pieces, and the word of each number."""
    known, parts = {BREAK: 0}, [np.zeros(0, np.int64)]
    raw = b"\n".join(t.encode() for t in texts).translate(FOLD).replace(b"\n", b" . ")
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + CHUNK)
        end = len(raw) if end < 0 else end
        if found := raw[start:end].split():  # spaces alone are left, of the white space that bytes are split at
            coded = pa.array(found, pa.binary()).dictionary_encode()
            numbers = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int64)
            parts.append(numbers[coded.indices.to_numpy()])
        start = end
    return np.concatenate(parts), list(known)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(ODD[0])
    return h ^ (h >> np.uint64(29))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return _mix(h * np.uint64(ODD[row]) + np.uint64(row)) >> np.uint64(64 - bits)


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, int, list[bytes], np.ndarray]]:
    """(lang, numbers, how many of them begin n-grams here, words, hashes of words); the rest of numbers is what follows."""
    for lang, texts in _texts(it):
        ids, names = _encode(texts)
        seed = zlib.crc32(lang.encode())
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names), np.uint64, len(names))
        for s in range(0, len(ids), WINDOW):
            yield lang, ids[s : s + WINDOW + LONGEST - 1], min(WINDOW, len(ids) - s), names, hashes


class Sketch:
    """The merged sketch: for each row, a bit for each cell that holds `least` or more."""

    def __init__(self, bits: int, rows: list[bytes]):
        self.bits, self.rows = bits, rows

    def may(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, packed in enumerate(self.rows):
            c = _cells(h, row, self.bits)
            out &= (np.frombuffer(packed, np.uint8)[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _levels(part: np.ndarray, hashes: np.ndarray, tests: dict[int, Sketch], last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, whether the n-gram at each place may be frequent, its hash), for lengths 1 to last; both parts of an n-gram
    must have passed, and its own cells where a sketch covers its length."""
    one = hashes[part]
    ok, h = part != 0, one
    for length in range(1, last + 1):
        if length > 1:
            ok, h = ok[:-1] & ok[1:], _mix(h[:-1] * np.uint64(ODD[1]) + one[length - 1 :])
        if length in tests:
            at = np.flatnonzero(ok)
            ok = ok.copy()
            ok[at] = tests[length].may(h[at])
        yield length, ok, h


def _sketch_rows(h: np.ndarray, bits: int, least: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(slab, steps, far, counts) of hashes: each cell as its distance from the one before it in the slab, a byte, with those
    of 255 or more in `far`; counts beyond `least` say no more than `least`."""
    keys, n = np.unique(h, return_counts=True)
    low = bits - SLAB_BITS
    for row in range(ROWS if len(keys) else 0):
        c = _cells(keys, row, bits).astype(np.int64)
        order = np.argsort(c, kind="stable")
        c = c[order]
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        cell, total = c[starts], np.minimum(np.add.reduceat(n[order], starts), least).astype(_kind(least))
        slab = cell >> low
        ends = np.flatnonzero(np.r_[slab[1:] != slab[:-1], True]) + 1
        for lo, hi in zip(np.r_[0, ends[:-1]], ends):
            steps = np.diff(cell[lo:hi], prepend=slab[lo] << low)
            yield (row << SLAB_BITS) + int(slab[lo]), np.minimum(steps, 255).astype(np.uint8).tobytes(), steps[steps >= 255].astype("<u4").tobytes(), total[lo:hi].tobytes()


def _kind(least: int) -> str:
    return "<u1" if least < 256 else "<u2"


def merged_sketch(docs: DataFrame, bits: int, lengths: range, tests: dict, least: int) -> Sketch:
    """The sketch of all n-grams of these lengths whose parts pass `tests` (length -> broadcast Sketch)."""

    def sketch(it: Iterator[pa.RecordBatch]):
        known = {k: b.value for k, b in tests.items()}
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rows = list(_sketch_rows(np.concatenate(held), bits, least)) if held else []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SKETCH)] if rows else [pa.array([], f.type) for f in SKETCH], schema=SKETCH)

        for _, part, starts, _, hashes in _windows(it):
            held += [h[:starts][ok[:starts]] for length, ok, h in _levels(part, hashes, known, lengths[-1]) if length in lengths]
            size += sum(map(len, held[-len(lengths) :]))
            if size >= HELD:
                yield out()
                held, size = [], 0
        yield out()

    low = bits - SLAB_BITS

    def add(it: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for b in it:
            for slab, steps, far, counts in zip(*(c.to_pylist() for c in b.columns)):
                total = sums.setdefault(slab, np.zeros(1 << low, _kind(least)))
                at = np.frombuffer(steps, np.uint8).astype(np.int64)
                at[at == 255] = np.frombuffer(far, "<u4")
                at = at.cumsum()
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(counts, _kind(least)), least)
        for slab, total in sums.items():
            yield pa.RecordBatch.from_pydict({"slab": pa.array([slab], pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

    partial = docs.mapInArrow(tidied(sketch), "slab int, steps binary, far binary, counts binary")
    got = {r.slab: bytes(r.bits) for r in partial.repartition("slab").mapInArrow(tidied(add), "slab int, bits binary").collect()}  # ROWS * 2 ** bits / 8 bytes
    empty = bytes((1 << low) // 8)
    return Sketch(bits, [b"".join(got.get((row << SLAB_BITS) + s, empty) for s in range(1 << SLAB_BITS)) for row in range(ROWS)])


def _counts(it: Iterator[pa.RecordBatch], known: dict[int, Sketch]) -> Iterator[tuple[tuple[str, int, bytes], int]]:
    """((lang, words, phrase), n) of the surviving n-grams of each window, and of its words with length 0 and no phrase."""
    for lang, part, starts, names, hashes in _windows(it):
        yield (lang, 0, b""), int((part[:starts] != 0).sum())
        ids = part
        for length, ok, _ in _levels(part, hashes, known, LONGEST):
            at = np.flatnonzero(ok[:starts])
            if not len(at):
                break
            # the number of the shorter n-gram here and that of the word that follows it tell n-grams apart exactly
            keys = part[at] if length == 1 else (ids[at] << 32) | part[at + length - 1]
            _, first, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            ids = np.zeros(starts, np.int64)
            ids[at] = inverse
            for p, k in zip(at[first].tolist(), n.tolist()):
                yield (lang, length, b" ".join([names[i] for i in part[p : p + length]])), k


def _counter(tests: dict, buckets: int) -> Callable:
    """The task that counts its rows exactly: one row for each bucket of phrases, whenever PHRASES are held and at the end."""

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for key, n in held.items():
            by.setdefault(zlib.crc32(key[2]) % buckets, []).append((key[0], key[1], key[2].decode(), n))
        for lo in range(0, len(by), 64):
            some = list(by.items())[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), *(pa.array([[r[i] for r in rows] for _, rows in some], PARTIAL.field(i + 1).type) for i in range(4))], schema=PARTIAL)

    def run(it: Iterator[pa.RecordBatch]):
        held: dict = {}
        for key, n in _counts(it, {k: b.value for k, b in tests.items()}):
            held[key] = held.get(key, 0) + n
            if len(held) >= PHRASES:
                yield from out(held)
                held = {}
        yield from out(held)

    return run


def _summed(least: int) -> Callable:
    """The task that adds up buckets, which come one after the other, and lets go of what is not frequent."""

    def out(held: dict) -> pa.RecordBatch:
        kept = [(*k, n) for k, n in held.items() if n >= least or k[1] == 0]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], f.type) for i, f in enumerate(COUNTED)], schema=COUNTED)

    def run(it: Iterator[pa.RecordBatch]):
        held, now = {}, None
        for b in it:
            for bucket, *lists in zip(*(c.to_pylist() for c in b.columns)):
                if bucket != now:
                    yield out(held)
                    held, now = {}, bucket
                for lang, words, phrase, n in zip(*lists):
                    held[lang, words, phrase] = held.get((lang, words, phrase), 0) + n
        yield out(held)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, n: all n-grams of 1 to LONGEST words that stand `least` times or more in a language, and its
    number of words (words 0, phrase empty); written to the scratch folder."""
    if not 1 <= least < 1 << 15:
        raise ValueError("least must be from 1 to 32767")
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, (size // BYTES_PER_CELL).bit_length()))
    held = []
    try:
        tests: dict = {}
        for lengths in (range(1, 3), range(3, LONGEST + 1)):
            held.append(sc.broadcast(merged_sketch(rows, bits, lengths, tests, least)))
            tests = tests | dict.fromkeys(lengths, held[-1])
        kind = "bucket int, lang array<string>, words array<int>, phrase array<string>, n array<long>"
        partial = rows.mapInArrow(tidied(_counter(tests, 1 << max(0, bits - BUCKET_BITS))), kind)
        total = partial.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_summed(least)), "lang string, words int, phrase string, n long")
        return materialize(total, "phrases")
    finally:
        for b in held:
            b.destroy()


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of every candidate: the cut that scores lowest."""
    f = counts.where("words > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = counts.where("words = 0").select("lang", "n")
    totals = F.broadcast(totals) if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else totals
    part = lambda at, n: F.array_join(F.slice(F.split("phrase", " "), at, n), " ")
    cut = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("words") - F.col("k"))})
    both = cut.join(f.withColumnsRenamed({"phrase": "first", "f": "l"}), ["lang", "first"]).join(f.withColumnsRenamed({"phrase": "rest", "f": "r"}), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 * cast(a as decimal(19,0)) as decimal(22,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = both.withColumn("score", score).groupBy("lang", "words", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "words", "phrase", "a", "b.l", "b.r", "n", "b.score")


def subsumed(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase of the candidates that a longer candidate holds, which is `share` percent as frequent or more."""
    words = F.split("phrase", " ")
    longer = counts.where("words > 2").select("lang", "words", words.alias("w"), F.col("n").alias("f"))
    spans = longer.select("lang", "w", "words", "f", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = spans.select("lang", "w", "m", "f", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    held = inner.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("f"))
    own = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"))
    return own.join(held, ["lang", "phrase"]).where(F.col("f").cast("decimal(22,0)") * 100 >= F.col("a").cast("decimal(22,0)") * share).select("lang", "phrase")


def ranked(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The best of each language: the best of each of its parts first, so that no task gets a language whole."""
    left = scored(counts).join(subsumed(counts), ["lang", "phrase"], "left_anti").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    some = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language. docs: lang, text."""
    counts = phrase_counts(docs, least)
    out = materialize(ranked(counts, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(counts)
    return out


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
grams AS (SELECT lang, w, i, unnest(range(1, 6)) AS m FROM starts),
counts AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM grams WHERE i + m - 1 <= len(w) GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY 1),
frequent AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100),
cuts AS (SELECT lang, m, phrase, f AS a, w, unnest(range(1, m)) AS k FROM frequent WHERE m > 1),
cut_scores AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:c.m], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, m, f, w, unnest(range(2, m)) AS len_ FROM frequent WHERE m > 2),
inner_ AS (SELECT lang, f, w, len_, unnest(range(1, m - len_ + 2)) AS i FROM spans),
held AS (SELECT lang, array_to_string(w[i:i + len_ - 1], ' ') AS phrase, max(f) AS f FROM inner_ GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.f IS NULL OR 100 * h.f < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
