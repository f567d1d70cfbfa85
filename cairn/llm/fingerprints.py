"""Operator 3, document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's distinct shingles of five words are hashed once; the top bits of a hash name its bin and each bin keeps its
least hash. An empty bin takes the value of a non-empty one, chosen by a hash of both bin numbers: the choice is uniform
over the non-empty bins and the same for every document (optimal densification). Of each bin's value BITS low bits are
kept, packed as hexadecimal digits. Bins agree by chance once in 2^BITS, so the share m of equal bins is corrected to
(m - 2^-BITS) / (1 - 2^-BITS), held to 0..1.

Words are what a split at white space (\\x09-\\x0d and space) gives after A-Z are lower-cased; a text of fewer than five
words is one shingle. Null text counts as empty; a text without words has the empty fingerprint, alike (1.0) to another
empty one and unlike (0.0) any other. Repeated rows each get a result; an empty table gives no row; very long texts are
shingled whole; rows that tie in doc_id follow each other in any order; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE = 5
BINS, BITS = 128, 8
BIN_SHIFT = 64 - BINS.bit_length() + 1
#: Documents of one range of doc_id, among which each finds its neighbour; more ranges than MAX_RANGES are not made.
DOCS_A_RANGE, MAX_RANGES = 2_048, 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"^[\x09-\x0d ]+|[\x09-\x0d ]+$", "")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x09-\x0d ]+"))


def shingle_hashes(text: Column) -> Column:
    """Sorted 64-bit hashes of the text's shingles (repeats stay; they fall into the same bin)."""

    def join(h: Column) -> Column:
        n = F.size(h)
        several = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        one = F.array(F.xxhash64(h, n))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, one).otherwise(several)

    return F.sort_array(let(F.transform(words_of(text), lambda w: F.xxhash64(w)), join))


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, BIN_SHIFT)


def bin_minima(sorted_hashes: Column) -> Column:
    """The least hash (as a signed number) of every non-empty bin; one per bin."""
    return let(sorted_hashes, lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))


def low_bits(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint"))


def fingerprint(text: Column) -> Column:
    """Hexadecimal fingerprint, BITS / 4 digits for each of BINS bins; empty without words."""

    def densify(m: Column) -> Column:
        full = F.transform(m, lambda h: bin_of(h).cast("int"))

        def by_bin(bins: Column) -> Column:
            def value(b: Column) -> Column:
                own = F.array_position(bins, b)
                lent = F.array_min(F.transform(m, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("k"), low_bits(h).alias("v")))).getField("v")
                return F.when(own > 0, low_bits(F.get(m, (own - 1).cast("int")))).otherwise(lent)

            every = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)
            return F.array_join(F.transform(every, lambda v: F.lpad(F.hex(v), BITS // 4, "0")), "")

        return F.when(F.size(m) == 0, F.lit("")).otherwise(let(full, by_bin))

    return F.lower(let(bin_minima(shingle_hashes(text)), densify))


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard likeness of two texts' shingle sets from their fingerprints."""
    width = BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * width + 1, F.lit(width)) == F.substring(b, i * width + 1, F.lit(width))))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with next_<c> for each of columns: the value in the next document by descending doc_id, after the last the first.

    Ranges of doc_id are dealt to tasks; a range also gets a copy of the row that follows its last, so one shuffle of
    the rows is enough. Rows of equal doc_id follow each other by text; a null doc_id comes last.
    """
    ids = docs.select("doc_id")
    n, least, most = ids.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = max(1, min(MAX_RANGES, n // DOCS_A_RANGE))
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 and most is not None else []
    cut_list = F.lit(cuts) if cuts else F.array().cast("array<bigint>")
    spot = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(range_of(F.col("doc_id"), cuts, cut_list))
    tops = {r.r: r.top for r in ids.select("doc_id", spot.alias("r")).groupBy("r").agg(F.max("doc_id").alias("top")).collect()}  # one row per range
    filled = sorted(tops)
    also: dict[int, list[int]] = {}  # a range's top row, for the next range up
    for below, above in zip(filled, filled[1:]):
        also.setdefault(tops[below], []).append(above) if tops[below] is not None else None
    guest = F.lit(None).cast("int")
    if also:
        guest_of = docs.sparkSession.createDataFrame([(k, v[0]) for k, v in also.items()], "doc_id long, guest int")
        marked = docs.join(F.broadcast(guest_of), "doc_id", "left")  # one row per range
    else:
        marked = docs.withColumn("guest", guest)
    first = filled[0] if filled else 0
    turn = (F.col("doc_id") == F.lit(most)) if most is not None else F.lit(True)
    places = F.array(
        F.struct(spot.alias("range"), F.lit(0).alias("late"), F.lit(True).alias("own")),
        F.when(F.col("guest").isNotNull(), F.struct(F.col("guest").alias("range"), F.lit(0).alias("late"), F.lit(False).alias("own"))),
        F.when(turn, F.struct(F.lit(first).alias("range"), F.lit(1).alias("late"), F.lit(False).alias("own"))),
    )
    dealt = marked.withColumn("place", F.explode(F.array_compact(places))).select(*docs.columns, "place.*")
    w = Window.partitionBy("range").orderBy("late", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("own").drop("range", "late", "own", "guest")


def range_of(doc_id: Column, cuts: list[int], cut_list: Column) -> Column:
    """How many cuts lie below doc_id, by binary search in an array of constants."""
    if not cuts:
        return F.lit(0)

    jumps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(jumps), F.lit(0), lambda at, j: F.when(F.coalesce(F.get(cut_list, at + j - 1) < doc_id, F.lit(False)), at + j).otherwise(at))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    printed = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(printed, ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    return (
        paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
        .withColumn("edited_fingerprint", fingerprint(F.col("edited")))
        .select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        )
    )
