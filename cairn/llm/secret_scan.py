"""Operator 10, secret scans, in DataFrame functions only.

Base spans come from three patterns (assign, access, hex). The method adds the kind `random`: long runs of letters,
digits and + / _ = - whose characters look drawn at random. Two first-order Markov models over character classes, one of
random strings and one of ordinary identifiers, are trained from labelled samples; a run is a finding where its mean
log-likelihood ratio (random over ordinary) exceeds THRESHOLD and no base span overlaps it.

Spans are [start, end) in code points. Edge cases: null text counts as empty; a document without findings gets counts of
0, the digest of no bytes and an empty string; repeated rows each get their result; an empty table gives no row; an
empty sample of a label leaves a flat model for it; very long texts are scanned whole; of spans that begin together the
kind listed first comes first. Further columns are kept, save those named found, _text, _runs or _base, which are dropped
(the pipeline gives columns of such names others while it works). Strings of fewer than RUN_LEAST characters that no base
pattern finds are not judged, as a few characters do not tell the two models apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, least lengths of what must be long enough, in the order of listing.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: A hex match shorter than HEX_LEAST is dropped anyway, so only longer runs that no hex digit precedes are looked for.
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{24,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
#: Runs that the models judge, their least length, and the mean log-likelihood ratio a character that makes a finding.
RUN_LEAST = 16
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST
THRESHOLD = 0.5
KINDS = ("assign", "access", "hex", "random")

#: Characters of a run; the last state of a model is any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Bounds of the labelled samples of the query.
MAX_SAMPLES = 20_000

def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, merge, start) -> Column:
    """For each of an array of numbers what merge makes of all before it, from start.

    A list grows by copying, so it is built in blocks of about the square root of its length: what comes before each block
    first, then within each.
    """

    def run(x: Column, begin: Column) -> Column:
        empty = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, v: F.struct(merge(acc.getField("at"), v).alias("at"), F.concat(acc.getField("out"), F.array(acc.getField("at"))).alias("out"))
        return F.aggregate(x, empty, step, lambda acc: acc.getField("out"))

    def blocks(v: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v)))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda j: F.slice(v, j * size + 1, size))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(let(cut, within))

    def within(parts: Column) -> Column:
        tops = run(F.transform(parts, lambda x: F.aggregate(x, start, merge)), start)
        return let(tops, lambda t: F.flatten(F.transform(parts, lambda x, j: run(x, F.get(t, j)))))

    return let(values, blocks)


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, stop, word>> of the pattern's leftmost non-overlapping matches, in code points.

    What lies between the matches is split off; the sums of both lengths give the offsets.
    """
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,word:string>>")

    def walk(pair: Column) -> Column:
        words, gaps = pair.getField("w"), pair.getField("g")
        at = before(F.transform(words, lambda w, i: F.length(F.get(gaps, i)) + F.length(w)), lambda a, b: a + b, F.lit(0))

        def spans(at: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(w)).alias("stop"), w.alias("word"))

            return F.transform(words, one)

        return let(at, spans)

    found = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"), F.split(text, pattern, -1).alias("g")), walk)
    if keep is not None:
        found = F.filter(found, keep)
    return F.when(text.rlike(pattern), found).otherwise(none)


def state(c: Column) -> Column:
    """Position of a character in ALPHABET, or the state of all others."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when((at == 0) | (F.length(c) != 1), F.lit(STATES - 1)).otherwise(at - 1)


def _states(word: Column) -> Column:
    return F.transform(F.split(word, ""), state)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the STATES * STATES transitions, from samples (word string, random boolean).

    Counts come from all rows of samples; each model adds one of every transition. What reaches the driver is one row
    per transition and label.
    """
    chars = samples.where(F.length("word") > 1).select("random", _states(F.col("word")).alias("s"))
    steps = chars.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i - 1) * STATES + F.get("s", i))).alias("t"))
    counts = {(r.random, r.t): r.n for r in steps.groupBy("random", "t").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in range(STATES):
        totals = {y: sum(counts.get((y, a * STATES + b), 0) for b in range(STATES)) + STATES for y in (True, False)}
        for b in range(STATES):
            p, q = ((counts.get((y, a * STATES + b), 0) + 1) / totals[y] for y in (True, False))
            out.append(math.log(p / q))
    return out


def mean_ratio(word: Column, ratios: Column) -> Column:
    def of(s: Column) -> Column:
        n = F.size(s)
        total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, i: acc + F.get(ratios, F.get(s, i - 1) * STATES + F.get(s, i)))
        return F.when(n < 2, F.lit(0.0)).otherwise(total / (n - 1))

    return let(_states(word), of)


def scan(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with `found`, the spans (start, kind, stop, word) of all kinds by start, then kind."""
    text = F.col("_text")
    group = lambda x: F.regexp_extract(x.getField("word"), ASSIGN, 2)
    base = F.concat(
        spans_of(text, ASSIGN, 0, lambda x: F.length(group(x)) >= ASSIGN_LEAST),
        spans_of(text, ACCESS_LONG, 1),
        spans_of(text, HEX_LONG, 2),
    )
    table = F.from_json(F.lit(str(ratios)), "array<double>")  # a constant, folded by the optimizer
    own = [c for c in docs.columns if c not in ("found", "_text", "_runs", "_base")]
    first = docs.select(*own, F.coalesce("text", F.lit("")).alias("_text"))
    second = first.select(*own, base.alias("_base"), spans_of(text, RUN, 3).alias("_runs"))
    apart = lambda x: ~F.exists("_base", lambda b: (b.getField("start") < x.getField("stop")) & (x.getField("start") < b.getField("stop")))
    random = F.filter("_runs", lambda x: apart(x) & (mean_ratio(x.getField("word"), table) > THRESHOLD))
    found = F.when((F.size("_runs") == 0) & (F.size("_base") == 0), F.col("_base")).otherwise(F.array_sort(F.concat("_base", F.when(F.size("_runs") == 0, F.col("_runs")).otherwise(random))))
    return second.select(*own, found.alias("found"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.getField("kind")), x.getField("start").cast("string"), x.getField("stop").cast("string"))), ",")


def default_samples(docs: DataFrame) -> DataFrame:
    """Labelled samples: random strings are SHA-256 digests of a counter as hex, base 64, base 36, letters of either case
    and UUIDs; ordinary identifiers are words of the corpus, alone and joined in pairs as identifiers are (snake, kebab,
    camel, path), with numbers, and numbers, dates and rules of one sign. At most MAX_SAMPLES of each."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    base64, base36 = F.rtrim(F.base64(F.unhex(digest)), F.lit("=")), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))
    letter = lambda i: F.char(F.lit(97) + F.conv(F.substring(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % 26)
    lower = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), letter), "")
    uuid = F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    strings = F.array(F.substring(digest, 1, 40), base64, base36, lower, F.upper(lower), uuid)
    random = spark.range(MAX_SAMPLES).select(F.get(strings, (F.col("id") % 6).cast("int")).alias("word"), F.lit(True).alias("random"))
    few = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    picked = few.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLES // 20)
    words = few.join(F.broadcast(picked.distinct()), "doc_id").select("doc_id", F.array_distinct(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 1)).alias("w")).where(F.size("w") > 3)
    a = F.get("w", F.pmod(F.xxhash64("doc_id", "k"), F.size("w")).cast("int"))
    b = F.get("w", F.pmod(F.xxhash64("doc_id", "k", F.lit(1)), F.size("w")).cast("int"))
    made = F.array(a, F.concat_ws("_", a, b), F.concat_ws("-", F.lower(a), b), F.concat(F.lower(a), F.initcap(b)), F.concat_ws("/", a, b), F.upper(F.concat_ws("_", a, b)))
    number = F.abs(F.xxhash64("doc_id", "k", F.lit(2))).cast("string")  # ids, dates, padded numbers and rules of one sign are ordinary too
    made = F.concat(made, F.array(F.concat_ws("_", a, F.substring(number, 1, 3)), number, F.concat_ws("-", F.lit("2024"), F.substring(number, 1, 2), F.substring(number, 3, 2)), F.concat(F.repeat(F.substring(number, 1, 1), 12), F.repeat(F.lit("-"), 6), F.repeat(F.lit("="), 6), F.repeat(F.lit("_"), 6), F.repeat(F.substring(F.lower(a), 1, 1), 6))))
    ordinary = words.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).select(F.get(made, F.pmod(F.col("k"), F.lit(10))).alias("word"), F.lit(False).alias("random"))
    return random.union(ordinary)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(default_samples(docs))).select("doc_id", "found")
    count = lambda k: F.size(F.filter("found", lambda x: x.getField("kind") == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("found", lambda x: x.getField("kind") < 3)).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
    )


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (overlapping ones as one) replaced by mark."""

    def cut(reached: Column) -> Column:
        """reached: up to where the spans before each one go."""

        def piece(x: Column, i: Column) -> Column:
            at, start = F.get(reached, i), x.getField("start")
            return F.when(start >= at, F.concat(F.substring(text, at + 1, start - at), F.lit(mark))).otherwise("")

        end = F.array_max(F.transform(found, lambda x: x.getField("stop")))
        return F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, end + 1, F.length(text)))

    stops = F.transform(found, lambda x: x.getField("stop"))
    return F.when(F.size(found) == 0, text).otherwise(let(before(stops, lambda a, b: F.greatest(a, b), F.lit(0)), cut))
