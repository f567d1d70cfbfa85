"""Place profiles, details and evidence lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import percent, py_strip


def place_chain(places: DataFrame, categories: DataFrame, districts: DataFrame, regions: DataFrame, outer: bool) -> DataFrame:
    """Places with category, district and region: candidates need all (outer=False), details keep places without."""
    how = "left" if outer else "inner"
    return places.join(F.broadcast(categories), "category_id").join(F.broadcast(districts), "district_id", how).join(F.broadcast(regions), "region_id", how)


def candidates_page(candidates: DataFrame, after_id: int, n: int) -> DataFrame:
    """Keyset page: the next n places after a place_id."""
    return candidates.where(F.col("place_id") > after_id).orderBy("place_id").limit(n)


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("place_id").agg(F.count(F.lit(1)).alias("reviews"))


def counts_with_zero(places: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews by place, places without any at 0."""
    return places.join(reviews.select("place_id", "review_id").hint("merge"), "place_id", "left").groupBy("place_id", *keys).agg(F.count("review_id").alias("reviews"))


def aspect_mentions(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct reviews by keys, aspect and sentiment."""
    return annotated.groupBy(*keys, "aspect", "sentiment").agg(F.countDistinct("review_id").alias("mentions"))


def context_counts(reviews: DataFrame, companions: DataFrame, keys: list[str]) -> DataFrame:
    return reviews.join(companions.hint("merge"), "review_id").groupBy(*keys, "companion").agg(F.countDistinct("review_id").alias("mentions"))


def context_sentiments(annotated: DataFrame, companions: DataFrame, keys: list[str]) -> DataFrame:
    """Annotations by companion and sentiment; an annotation counts once for each companion of its review."""
    return annotated.join(companions.hint("merge"), "review_id").groupBy(*keys, "companion", "sentiment").agg(F.count(F.lit(1)).alias("n"))


def context_satisfaction(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of positive among positive and negative; companions without either are left out."""
    pos, neg = (F.sum(F.when(F.col("sentiment") == s, F.col("n")).otherwise(0)) for s in ("positive", "negative"))
    both = counts.groupBy(*keys, "companion").agg(pos.alias("pos"), neg.alias("neg")).where("pos + neg > 0")
    return both.select(*keys, "companion", percent(F.col("pos"), F.col("pos") + F.col("neg")).alias("satisfaction"))


def place_profile(places: DataFrame, reviews: DataFrame, annotated: DataFrame, companions: DataFrame) -> DataFrame:
    """One row per place: review count, aspects with share, contexts with share, satisfaction by context.

    Joins are told to sort: by the size of their compressed files Spark would broadcast rows of all places or reviews.
    """
    total = counts_with_zero(places, reviews, [])
    with_total = lambda df: df.join(total.hint("merge"), "place_id")
    aspects = with_total(aspect_mentions(annotated, ["place_id"])).groupBy("place_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("mentions")).alias("o"), "aspect", "sentiment", percent(F.col("mentions"), F.col("reviews")).alias("share")))).alias("aspects")
    )
    contexts = with_total(context_counts(reviews, companions, ["place_id"])).select("place_id", "companion", percent(F.col("mentions"), F.col("reviews")).alias("share"))
    contexts = contexts.groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("o"), "companion", "share"))).alias("contexts"))
    sat = context_satisfaction(context_sentiments(annotated, companions, ["place_id"]), ["place_id"])
    sat = sat.groupBy("place_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("companion", "satisfaction")))).alias("context_satisfaction"))
    out = total.join(aspects.hint("merge"), "place_id", "left").join(contexts.hint("merge"), "place_id", "left").join(sat.hint("merge"), "place_id", "left")
    return out.withColumn("aspects", F.transform("aspects", lambda x: F.struct(x.aspect.alias("aspect"), x.sentiment.alias("sentiment"), x.share.alias("share")))).withColumn(
        "contexts", F.transform("contexts", lambda x: F.struct(x.companion.alias("companion"), x.share.alias("share")))
    )


def latest_reviews(reviews: DataFrame, k: int = 3) -> DataFrame:
    """The k newest non-synthetic reviews of each place; blank ones use up a rank and are then left out."""
    w = Window.partitionBy("place_id").orderBy(F.desc("review_id"))
    newest = reviews.where("is_synthetic = false").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return newest.where(py_strip(F.col("review_text")) != "")


def representative_evidence(annotated: DataFrame) -> DataFrame:
    """One evidence per place, aspect and sentiment: Gold first, short ones last, then the shortest, then the first id."""
    w = Window.partitionBy("place_id", "aspect", "sentiment").orderBy(
        F.when(F.col("tier") == "gold", 0).otherwise(1), F.when(F.length("evidence_text") < 8, 1).otherwise(0), F.length("evidence_text"), "annotation_id"
    )
    return annotated.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def evidence(annotated: DataFrame, companions: DataFrame, sentiment: str | None = None, companion: str | None = None, limit: int | None = None) -> DataFrame:
    """Evidence rows with the companions of their review, in order of review and start."""
    if sentiment is not None:
        annotated = annotated.where(F.col("sentiment") == sentiment)
    if companion is not None:
        annotated = annotated.join(companions.where(F.col("companion") == companion).select("review_id"), "review_id", "left_semi")
    named = companions.groupBy("review_id").agg(F.array_join(F.sort_array(F.collect_set("companion")), ", ").alias("context"))
    out = annotated.join(named, "review_id", "left")
    return out if limit is None else out.orderBy("review_id", "annotation_id").limit(limit)


def main_image(images: DataFrame) -> DataFrame:
    """The foremost image of each place that is marked as main; images are in order of is_main, sort_order, id."""
    w = Window.partitionBy("place_id").orderBy(F.desc("is_main"), "sort_order", "image_id")
    return images.withColumn("position", F.row_number().over(w))


def resolve_scraps(scraps: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scraps with their place (own, else that of their review), and those without any."""
    of_review = reviews.select("review_id", F.col("place_id").alias("review_place"))
    found = scraps.join(of_review, "review_id", "left").withColumn("place_id", F.coalesce("place_id", "review_place")).drop("review_place")
    return found.where("place_id is not null"), found.where("place_id is null")


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching [start, stop) spans of a key as one; spans without bounds add none where the key has others."""
    w = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), F.col("stop").asc_nulls_last())
    far = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(far.isNull() | (F.col("start") > far), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
