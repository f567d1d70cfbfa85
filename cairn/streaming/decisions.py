"""Human decisions on drafts: pending, gold or discarded (ST4). One set of expressions serves a whole log and a stream of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.checks import Vocabulary, gold_faults
from cairn.streaming.logs import update_state

DECISION = ("action", "traveler_context", "aspects", "reviewer", "at", "note")


def judged(log: DataFrame, silver: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """log with `errors`: why a decision can't be taken, empty where it can.

    log: event_id, review_id, at, action (approve, discard or reset), reviewer, note, and for an approval the label
    (traveler_context, aspects). A review must be of silver (review_id, category, review, traveler_context, aspects), and
    an approved label without faults.
    """
    known = silver.select("review_id", F.col("category").alias("_kind"), F.col("review").alias("_review"))
    met = log.join(known, "review_id", "left")
    faults = gold_faults(vocabulary, F.col("_kind"), F.col("_review"), F.col("traveler_context"), F.col("aspects"))
    none = F.array().cast("array<string>")
    errors = F.when(F.col("_kind").isNull(), F.array(F.lit("no such review"))).when(F.col("action") == "approve", faults).when(F.col("action").isin("discard", "reset"), none).otherwise(F.array(F.lit("no such action")))
    return met.withColumn("errors", errors).drop("_kind", "_review")


def latest(judged_log: DataFrame) -> DataFrame:
    """review_id and its last decision without errors. Each replaces all of the one before, so the last is the state."""
    return judged_log.where(F.size("errors") == 0).groupBy("review_id").agg(F.max_by(F.struct(*DECISION, "event_id"), F.struct("at", "event_id")).alias("decision")).select("review_id", "decision.*")


def _is(state: DataFrame, silver: DataFrame, action: str) -> DataFrame:
    return silver.alias("s").join(state.where(F.col("action") == action).alias("d"), "review_id")


def _decision(*more: Column) -> Column:
    return F.struct("d.reviewer", F.col("d.at").alias("reviewed_at"), "d.note", *more).alias("decision")


def gold(state: DataFrame, silver: DataFrame) -> DataFrame:
    """Approved records with the label that a person gave, the draft's beside it, and whether the two differ."""
    label = lambda side: F.struct(F.col(f"{side}.traveler_context").alias("traveler_context"), F.col(f"{side}.aspects").alias("aspects"))
    edited = ~F.to_json(label("d")).eqNullSafe(F.to_json(label("s")))
    return _is(state, silver, "approve").select("review_id", "s.category", "s.review", "d.traveler_context", "d.aspects", F.lit("gold").alias("tier"), label("s").alias("silver_label"), _decision(edited.alias("edited")))


def discarded(state: DataFrame, silver: DataFrame) -> DataFrame:
    return _is(state, silver, "discard").select("s.*", _decision())


def statuses(state: DataFrame, silver: DataFrame) -> DataFrame:
    """review_id and status of every draft; reset ones are pending again."""
    status = F.when(F.col("action") == "approve", "gold").when(F.col("action") == "discard", "discarded").otherwise("pending")
    return silver.select("review_id").join(state.select("review_id", "action"), "review_id", "left").select("review_id", status.alias("status"))


def run_decisions(log: DataFrame, silver: DataFrame, vocabulary: Vocabulary, root: str, checkpoint: str) -> None:
    """Take what has arrived of a streamed log into the keyed state under root, and stop.

    The stream's own state is the last valid decision of each review, so decisions may come late or out of order; what
    changed goes over the last version of the table as the next one.
    """

    def batch(changed: DataFrame, _: int) -> None:
        if changed.limit(1).count():
            update_state(changed, root, "review_id")

    latest(judged(log, silver, vocabulary)).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
