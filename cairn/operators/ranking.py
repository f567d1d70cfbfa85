"""Scores of places from counts of labelled mentions, weighted by a traveller's conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import vocab

SHRINK = 2
STRENGTH_MIN, CAUTION_MAX = 60.0, 40.0
LEAST_FIT = 40


def goodness_raw(pos: Column, neg: Column, neu: Column) -> Column:
    """Satisfaction 0..100, drawn towards 50 while mentions are few."""
    m = pos + neg + neu
    raw = 100 * (pos + 0.5 * neu) / m
    return F.when(m == 0, F.lit(50.0)).otherwise(50 + (raw - 50) * m / (m + SHRINK))


def sentiment_pivot(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """pos, neg, neu counts by keys, in one aggregation."""
    count = lambda s: F.count_if(F.col("sentiment") == s)
    return annotations.groupBy(*keys).agg(count("positive").alias("pos"), count("negative").alias("neg"), count("neutral").alias("neu"))


def scored_aspects(counts: DataFrame) -> DataFrame:
    g = goodness_raw(F.col("pos"), F.col("neg"), F.col("neu"))
    return counts.withColumn("mentions", F.col("pos") + F.col("neg") + F.col("neu")).withColumn("goodness_raw", g).withColumn("goodness", F.bround("goodness_raw", 1))


def condition_weights(conditions: dict[str, list[str]]) -> dict[str, float]:
    """Aspect weights of conditions such as {"with": ["parents"], "avoid": ["stairs"]}; each keyword counts once."""
    named = [vocab.CONDITION_KEYWORDS[kind].get(c) for kind in ("with", "walk", "pri", "avoid") for c in conditions.get(kind, [])]
    out: dict[str, float] = {}
    for keyword in dict.fromkeys(k for k in named if k):
        for aspect, w in vocab.KEYWORDS[keyword][1].items():
            out[aspect] = out.get(aspect, 0.0) + w
    return out


def weight_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(weights.items())], "aspect string, weight double")


def weighted(aspects: DataFrame, weights: DataFrame | None) -> DataFrame:
    """aspects with their weight; only weighted ones, or all at weight 1 without conditions."""
    if weights is None:
        return aspects.withColumn("weight", F.lit(1.0))
    return aspects.join(F.broadcast(weights), "aspect")  # one row per aspect of the vocabulary


def fit_column() -> Column:
    """50 plus the weighted mean of (goodness - 50); sums are exact, as both have few decimals."""
    w = F.col("weight").cast("decimal(10,2)")
    return F.lit(50.0) + F.sum(w * (F.col("goodness").cast("decimal(10,1)") - 50)).cast("double") / F.sum(w).cast("double")


def parts(strong: bool, most: int | None) -> Column:
    """Strengths or cautions of the group's aspects, largest contribution first, then by name."""
    gain = F.col("weight") * ((F.col("goodness") - 50) if strong else (50 - F.col("goodness")))
    test = F.col("goodness") >= STRENGTH_MIN if strong else F.col("goodness") <= CAUTION_MAX
    found = F.sort_array(F.collect_list(F.when(test, F.struct((-gain).alias("g"), F.col("aspect").alias("aspect")))))
    names = F.transform(found, lambda x: x.getField("aspect"))
    return names if most is None else F.slice(names, 1, most)


def score_places(candidates: DataFrame, aspects: DataFrame, totals: DataFrame, weights: DataFrame | None, limit: int | None = None) -> DataFrame:
    """Places with a fit of LEAST_FIT at least, best first: by fit, number of reviews, place_id.

    candidates: place_id and what describes a place; aspects: as scored_aspects, by place_id; totals: place_id, reviews.
    """
    fits = weighted(aspects, weights).groupBy("place_id").agg(fit_column().alias("fit_raw"), parts(True, None).alias("strengths"), parts(False, None).alias("cautions"))
    out = candidates.join(fits.where(F.col("fit_raw") >= LEAST_FIT), "place_id").join(totals, "place_id", "left")
    out = out.withColumn("fit", F.bround("fit_raw", 1)).withColumn("reviews", F.coalesce("reviews", F.lit(0)))
    if limit is None:
        return out
    return out.orderBy(F.desc("fit"), F.desc("reviews"), "place_id").limit(limit)


def score_scraps(places: DataFrame, aspects: DataFrame, totals: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores of saved places (place_id and what else places has): matched ones by their weighted aspects, others by all of theirs, those without any at 50."""
    own = aspects.join(F.broadcast(weights), "aspect", "left")
    matched = own.groupBy("place_id").agg(F.count("weight").alias("hits"))
    used = own.join(matched, "place_id").where((F.col("hits") == 0) | F.col("weight").isNotNull()).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    fits = used.groupBy("place_id").agg(fit_column().alias("fit"), F.max(F.col("hits") > 0).alias("matched"), parts(True, 3).alias("strengths"), parts(False, 3).alias("cautions"))
    none = F.array().cast("array<string>")
    out = places.join(fits, "place_id", "left").join(totals, "place_id", "left").select(
        *places.columns, F.coalesce(F.bround("fit", 1), F.lit(50.0)).alias("fit"), F.coalesce("matched", F.lit(False)).alias("matched"), F.coalesce("reviews", F.lit(0)).alias("reviews"),
        F.coalesce("strengths", none).alias("strengths"), F.coalesce("cautions", none).alias("cautions"),
    )
    return out


def ranked(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Ordinal ranks in each traveller's list: matched first, then fit, reviews, place_id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("matched"), F.desc("fit"), F.desc("reviews"), "place_id")
    return scored.withColumn("rank", F.row_number().over(order))


def reason(strengths: Column, cautions: Column, matched: Column) -> Column:
    """Sentence on the two foremost strengths and cautions; its wording is a fixed value."""
    good, bad = (F.array_join(F.slice(c, 1, 2), ", ") for c in (strengths, cautions))
    subject = F.when(matched, F.lit("요구사항과 관련해")).otherwise(F.lit("리뷰 전반에서"))
    return (
        F.when((good != "") & (bad != ""), F.concat(subject, F.lit(" "), good, F.lit(" 평가가 좋지만 "), bad, F.lit("은(는) 아쉽다는 리뷰가 있어요.")))
        .when(good != "", F.concat(subject, F.lit(" "), good, F.lit(" 평가가 좋아요.")))
        .when(bad != "", F.concat(subject, F.lit(" "), bad, F.lit("에 대한 아쉬운 리뷰가 있어요.")))
        .otherwise(F.lit("요구사항과 관련된 리뷰가 적어 판단 근거가 부족해요."))
    )
