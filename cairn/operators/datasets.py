"""Assembly of training and test sets from reviews, labels and splits (PF20-PF23, R6, R13-R15, R19, F31, F32)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import py_strip
from cairn.operators import curation, labels, ranking
from cairn.operators.numbering import number_by_value


def route_splits(records: DataFrame, splits: DataFrame, keep: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """records with the split of their place, rows of the kept splits only; a place without a split is an error."""
    joined = records.join(splits, "place_id", "left")
    checked = F.when(F.col("split").isNull(), F.raise_error(F.concat(F.lit("no split for place "), F.coalesce(F.col("place_id").cast("string"), F.lit("null")))).cast("string")).otherwise(F.col("split"))
    return joined.withColumn("split", checked).where(F.col("split").isin(*keep))


def gold_only(records: DataFrame) -> DataFrame:
    """records, or an error at the first one that is not Gold."""
    checked = F.when(F.col("tier") == "gold", F.col("tier")).otherwise(F.raise_error(F.concat(F.lit("not Gold: "), F.coalesce(F.col("review_id").cast("string"), F.lit("null")))).cast("string"))
    return records.withColumn("tier", checked)


def unify(sources: list[DataFrame], splits: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One set from several sources: allowed splits, review evidence only, one row per place and text (the first source, then the first row)."""
    rows = None
    for rank, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(rank))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    kept = rows.join(splits, "place_id", "left").where(F.col("split").isin(*keep)).withColumn("aspects", labels.review_only(F.col("aspects")))
    return curation.first_wins(kept.withColumn("_text", py_strip(F.col("review"))), ["place_id", "_text"], ["_rank", "pos"]).drop("_rank", "_text")


def first_labels(rows: DataFrame, name: str, label: str, pos: str) -> DataFrame:
    """The first non-empty label of every name."""
    some = rows.where(F.coalesce(F.col(label), F.lit("")) != "")
    return some.groupBy(name).agg(F.min_by(label, pos).alias("known_label"))


def select_reviews(rows: DataFrame, bucket: Column, per_place: int, plain_share: float, seed: str) -> DataFrame:
    """rows (pos, name, label, review, category) that no rule drops, capped by place and by the share of plain ones."""
    known = rows.join(first_labels(rows, "name", "label", "pos"), "name", "left")
    kept = curation.drop_reasons(known).where("reason is null").withColumn("bucket", bucket)
    capped = curation.cap_by_bucket(kept, ["name"], "bucket", ["not_positive", "rich", "plain"], "pos", per_place, seed)
    return curation.cap_share(capped, ["category"], F.col("bucket") == "plain", plain_share, "pos", seed)


def length_batches(rows: DataFrame, text: str, size: int, tie: str) -> DataFrame:
    """rows with the number of their batch of like lengths, within the text's length class.

    Classes of twice the length each keep batches alike in length.
    """
    level = F.floor(F.log2(F.length(text) + 1)).cast("int")
    numbered = number_by_value(rows.withColumn("_length", F.length(text)).withColumn("level", level), ["level"], "_length", tie, "_i")
    return numbered.withColumn("batch", F.floor((F.col("_i") - 1) / size).cast("long")).drop("_i", "_length")


def sft_example(system: str, review: Column, label: Column) -> Column:
    """Prompt and completion of a supervised example; the completion is the label as compact JSON."""
    return F.struct(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), review.alias("content"))).alias("prompt"), F.to_json(label).alias("completion"))


def important_aspects(items: DataFrame, keys: list[str], weight: float = 3.0) -> DataFrame:
    """Weights from an interpreted wish: aspects named positive or negative, unless the same wish also says neutral."""
    said = items.groupBy(*keys, "aspect").agg(F.max(F.col("sentiment") == "neutral").alias("ignored"))
    return said.where("not ignored").select(*keys, "aspect", F.lit(weight).alias("weight"))


def compare_conditions(labelled: DataFrame, reviews: DataFrame, weights: DataFrame | None, conditions: list[str]) -> DataFrame:
    """Fit of every place under each condition's own labels (condition, place_id, aspect, sentiment)."""
    counts = ranking.sentiment_pivot(labelled, [*conditions, "place_id", "aspect"])
    scored = ranking.weighted(ranking.scored_aspects(counts), weights)
    fits = scored.groupBy(*conditions, "place_id").agg(ranking.fit_column().alias("fit_raw")).where(F.col("fit_raw") >= ranking.LEAST_FIT)
    return fits.join(reviews, "place_id", "left").select(*conditions, "place_id", F.bround("fit_raw", 1).alias("fit"), F.coalesce("reviews", F.lit(0)).alias("reviews"))


def first_in(values: Column, test) -> Column:
    """The first element that passes, else the first one at all; null of an empty list."""
    return F.coalesce(F.get(F.filter(values, test), F.lit(0)), F.get(values, F.lit(0)))
