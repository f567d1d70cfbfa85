"""A training-data pipeline over documents: toxicity, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of documents. run()
writes every stage as Parquet in the shared scratch folder and reads it back as the next one's input, so a lost executor
costs tasks of one stage; the input of a stage is deleted once its result stands.

Null texts count as empty and pass every filter. Repeated rows are judged alike; of rows of equal or near-equal texts the
Jaccard stage keeps one. Rows are told apart by doc_id (or, where that is null, a hash of the text) and a hash of the
text, so a clean row stays where another row of its doc_id goes. Very long texts are read whole; ties go to the least
doc_id. An empty table stays empty. Further columns are kept, whatever their names: while a stage works they go by names
that no operator uses. The last stage replaces columns named like what it adds (ids, parity, round_trip).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontamination, jaccard_join, secret_scan, sentencepiece_codec, toxicity
from cairn.llm.memory import give_back
from cairn.session import discard, materialize, ship, table

#: Rows up to which a list of documents to drop is broadcast; longer ones are shuffled.
BROADCAST_ROWS = 1_000_000


def kept_apart(stage: Callable) -> Callable:
    """The stage, with all columns but doc_id and text under names of no operator; further ones that it returns stay last."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*names), sf_dir)
        added = [c for c in out.columns if c not in names]
        kept = [F.col(n).alias(c) for n, c in zip(names, docs.columns) if c not in added]
        return out.select(*kept, *added)

    return run


def _marked(docs: DataFrame) -> DataFrame:
    """docs with _ref and _th, by which the operators' results find a row again."""
    return docs.withColumns({"_ref": F.expr(jaccard_join.REF), "_th": F.xxhash64("text")})


def _without(docs: DataFrame, dropped: DataFrame, on: list[str]) -> DataFrame:
    dropped = F.broadcast(dropped) if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dropped
    return _marked(docs).join(dropped, on, "left_anti").select(*docs.columns)


def _begin(spark: SparkSession) -> None:
    """What the driver still holds of the stage before goes first: plans and broadcasts in the JVM, too, whose heap shrinks."""
    ship(spark)
    spark.sparkContext._jvm.System.gc()
    give_back()


@kept_apart
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject. Without labels, all stay.

    Null and empty texts have no toxic word and stay; very long ones are scored whole, repeated rows alike; an empty table
    stays empty."""
    _begin(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.where("predicted = 0").select(*docs.columns)


@kept_apart
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of every connected group of 75 % alike ones; all without a word stay.

    Null texts have no word. Ties (rows of one doc_id and text, or without doc_id and of one text) go to any one row; very
    long texts are compared whole; an empty table stays empty."""
    _begin(spark)
    joined = materialize(jaccard_join.jaccard_join(docs).select(F.col("ref").alias("_ref"), F.col("th").alias("_th"), "first", "n_shingles"), "groups")
    kept = _without(docs, joined.where("not first").select("_ref", "_th").distinct(), ["_ref", "_th"])
    repeated = joined.where("first and n_shingles > 0").groupBy("_ref", "_th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_ref", "_th")
    if repeated.limit(1).count() == 0:
        return kept
    once = _marked(kept).join(repeated, ["_ref", "_th"], "left_semi").dropDuplicates(["_ref", "_th"])
    return _without(kept, repeated, ["_ref", "_th"]).union(once.select(*docs.columns))


@kept_apart
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; an empty benchmark drops none.

    Null and empty texts hold none; very long ones are searched whole; repeated rows go together; an empty table stays
    empty."""
    _begin(spark)
    row = F.xxhash64("_ref", "_th")
    rows = _marked(docs).select(row.alias("doc_id"), "text")
    leaks = materialize(decontamination.find_leaks(rows, table(spark, sf_dir, "benchmark"), decontamination.PIPELINE_WORDS).select("doc_id").distinct(), "leaks")
    leaking = leaks.withColumnRenamed("doc_id", "_row")
    leaking = F.broadcast(leaking) if leaking.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else leaking
    return _marked(docs).withColumn("_row", row).join(leaking, "_row", "left_anti").select(*docs.columns)


@kept_apart
def _redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratios = secret_scan.train(secret_scan.default_samples(docs))
    clean = secret_scan.redact(F.col("text"), F.col("found"))
    return secret_scan.scan(docs, ratios).withColumn("text", F.when(F.col("text").isNotNull(), clean)).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced; n_chars, where there is one, follows the text.

    Null texts stay null, very long ones are scanned whole, repeated rows are redacted alike; overlapping finds are replaced
    as one; an empty table stays empty."""
    _begin(spark)
    out, kind = _redacted(spark, docs, sf_dir), dict(docs.dtypes)
    return out.withColumn("n_chars", F.length("text").cast(kind["n_chars"])).select(*docs.columns) if "n_chars" in kind else out


@kept_apart
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its SentencePiece ids (none for a null or empty text); very long texts are encoded whole, repeated
    rows alike; an empty table stays empty."""
    _begin(spark)
    return sentencepiece_codec.encode(docs, sentencepiece_codec.model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("sentencepiece", encode),
]
#: SQL expresses neither the fitted models nor the tokenizer; tests/llm holds the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
