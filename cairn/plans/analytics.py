"""Queries of the analytics service: profiles, evidence, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import profile, ranking
from cairn.plans import star
from cairn.plans.registry import query
from cairn.session import table

WEIGHTS = {"ECONOMY": 2.0, "PROMO": 1.5, "STANDARD": 3.0}


def aspects(spark, d):
    return ranking.scored_aspects(ranking.sentiment_pivot(star.annotated(spark, d), ["place_id", "aspect"]))


def totals(spark, d):
    return profile.review_counts(star.reviews(spark, d))


def weights(spark, d):
    """Weights of three of the aspect names that the tables have, by their order."""
    names = table(spark, d, "part").select(F.col("p_type").alias("aspect")).distinct()
    ordered = names.withColumn("i", F.expr("row_number() OVER (ORDER BY aspect)"))  # six names
    return ordered.where("i <= 3").select("aspect", F.element_at(F.array(F.lit(2.0), F.lit(1.5), F.lit(3.0)), F.col("i")).alias("weight"))


WEIGHTS_SQL = "weights AS (SELECT aspect, [2.0::DOUBLE, 1.5::DOUBLE, 3.0::DOUBLE][i] AS weight FROM (SELECT p_type AS aspect, row_number() OVER (ORDER BY p_type) AS i FROM (SELECT DISTINCT p_type FROM part)) WHERE i <= 3)"
FIT_SQL = "50::DOUBLE + sum(weight::DECIMAL(10,2) * (goodness::DECIMAL(10,1) - 50))::DOUBLE / sum(weight::DECIMAL(10,2))::DOUBLE"


@query("candidates_inner_chain", star.sql("SELECT * FROM candidates WHERE region IN ('ASIA', 'EUROPE')"))
def candidates_inner_chain(spark, d):
    return star.candidates(spark, d).where(F.col("region").isin("ASIA", "EUROPE"))


@query(
    "detail_left_chain",
    "SELECT c_custkey AS place_id, c_name AS place_name, n_name AS district, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = nullif(c_nationkey, 3) LEFT JOIN region ON n_regionkey = r_regionkey",
)
def detail_left_chain(spark, d):
    """Details keep places without a district: nation 3 stands for a missing one."""
    places = table(spark, d, "customer").selectExpr("c_custkey AS place_id", "c_name AS place_name", "c_mktsegment AS category_id", "nullif(c_nationkey, 3) AS district_id")
    districts = table(spark, d, "nation").selectExpr("n_nationkey AS district_id", "n_name AS district", "n_regionkey AS region_id")
    regions = table(spark, d, "region").selectExpr("r_regionkey AS region_id", "r_name AS region")
    categories = places.select("category_id").distinct()
    return profile.place_chain(places, categories, districts, regions, outer=True).select("place_id", "place_name", "district", "region")


@query("candidates_page", star.sql("SELECT * FROM candidates WHERE place_id > 40 ORDER BY place_id LIMIT 25"))
def candidates_page(spark, d):
    return profile.candidates_page(star.candidates(spark, d), 40, 25)


@query("place_review_counts", star.sql("SELECT place_id, count(*) AS reviews FROM reviews GROUP BY 1"))
def place_review_counts(spark, d):
    return totals(spark, d)


@query("place_counts_with_zero", "SELECT p_partkey AS place_id, p_brand AS brand, count(l_orderkey) AS reviews FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL")
def place_counts_with_zero(spark, d):
    reviews = table(spark, d, "lineitem").selectExpr("l_partkey AS place_id", "l_orderkey AS review_id")
    return profile.counts_with_zero(table(spark, d, "part").selectExpr("p_partkey AS place_id", "p_brand AS brand"), reviews, ["brand"])


@query("sentiment_counts", star.sql("SELECT place_id, aspect, sentiment, count(*) AS n FROM annotated GROUP BY ALL"))
def sentiment_counts(spark, d):
    return star.annotated(spark, d).groupBy("place_id", "aspect", "sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("sentiment_pivot", star.sql("SELECT place_id, aspect, pos, neg, neu FROM counts", star.SCORES[0]))
def sentiment_pivot(spark, d):
    return ranking.sentiment_pivot(star.annotated(spark, d), ["place_id", "aspect"])


@query("aspect_mentions", star.sql("SELECT place_id, aspect, sentiment, count(DISTINCT review_id) AS mentions FROM annotated GROUP BY ALL"))
def aspect_mentions(spark, d):
    return profile.aspect_mentions(star.annotated(spark, d), ["place_id"])


@query("context_counts", star.sql("SELECT place_id, companion, count(DISTINCT review_id) AS mentions FROM reviews JOIN companions USING (review_id) GROUP BY ALL"))
def context_counts(spark, d):
    return profile.context_counts(star.reviews(spark, d), star.companions(spark, d), ["place_id"])


@query("context_sentiments", star.sql("SELECT place_id, companion, sentiment, count(*) AS n FROM annotated JOIN companions USING (review_id) GROUP BY ALL"))
def context_sentiments(spark, d):
    return profile.context_sentiments(star.annotated(spark, d), star.companions(spark, d), ["place_id"])


SATISFACTION = "sat AS (SELECT place_id, companion, count(*) FILTER (sentiment = 'positive') AS pos, count(*) FILTER (sentiment = 'negative') AS neg FROM annotated JOIN companions USING (review_id) GROUP BY ALL)"


@query("context_satisfaction", star.sql("SELECT place_id, companion, round_even(pos / (pos + neg) * 100, 1) AS satisfaction FROM sat WHERE pos + neg > 0", SATISFACTION))
def context_satisfaction(spark, d):
    return profile.context_satisfaction(profile.context_sentiments(star.annotated(spark, d), star.companions(spark, d), ["place_id"]), ["place_id"])


@query(
    "place_profile",
    star.sql(
        """SELECT c.place_id, coalesce(t.reviews, 0) AS reviews, a.aspects, x.contexts, s.satisfaction FROM candidates c LEFT JOIN totals t USING (place_id)
        LEFT JOIN (SELECT place_id, string_agg(aspect || '/' || sentiment || '=' || CAST(share AS VARCHAR), ';' ORDER BY -mentions, aspect, sentiment) AS aspects FROM (SELECT m.*, round_even(mentions / reviews * 100, 1) AS share FROM mentions m JOIN totals USING (place_id)) GROUP BY 1) a USING (place_id)
        LEFT JOIN (SELECT place_id, string_agg(companion || '=' || CAST(share AS VARCHAR), ';' ORDER BY -share, companion) AS contexts FROM (SELECT m.*, round_even(mentions / reviews * 100, 1) AS share FROM contexts m JOIN totals USING (place_id)) GROUP BY 1) x USING (place_id)
        LEFT JOIN (SELECT place_id, string_agg(companion || '=' || CAST(round_even(pos / (pos + neg) * 100, 1) AS VARCHAR), ';' ORDER BY companion) AS satisfaction FROM sat WHERE pos + neg > 0 GROUP BY 1) s USING (place_id)""",
        star.SCORES[2], SATISFACTION, "mentions AS (SELECT place_id, aspect, sentiment, count(DISTINCT review_id) AS mentions FROM annotated GROUP BY ALL)", "contexts AS (SELECT place_id, companion, count(DISTINCT review_id) AS mentions FROM reviews JOIN companions USING (review_id) GROUP BY ALL)",
    ),
)
def place_profile(spark, d):
    p = profile.place_profile(star.candidates(spark, d).select("place_id"), star.reviews(spark, d), star.annotated(spark, d), star.companions(spark, d))
    text = lambda c, f: F.array_join(F.transform(c, f), ";")
    return p.select(
        "place_id", "reviews", text("aspects", lambda x: F.concat(x.aspect, F.lit("/"), x.sentiment, F.lit("="), x.share.cast("string"))).alias("aspects"), text("contexts", lambda x: F.concat(x.companion, F.lit("="), x.share.cast("string"))).alias("contexts"),
        text(F.array_sort(F.map_entries("context_satisfaction")), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string"))).alias("satisfaction"),
    )


@query("latest_reviews_topk", star.sql("SELECT place_id, review_id, review_text, rank FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY review_id DESC) AS rank FROM reviews WHERE NOT is_synthetic) WHERE rank <= 3 AND review_text <> '5-LOW'"))
def latest_reviews_topk(spark, d):
    """Priority 5 stands for blank texts: they use up a rank."""
    r = star.reviews(spark, d).withColumn("review_text", F.when(F.col("review_text") == "5-LOW", F.lit(" 　")).otherwise(F.col("review_text")))
    return profile.latest_reviews(r).select("place_id", "review_id", "review_text", "rank")


@query(
    "representative_evidence",
    star.sql("SELECT place_id, aspect, sentiment, tier, evidence_text, annotation_id FROM annotated QUALIFY row_number() OVER (PARTITION BY place_id, aspect, sentiment ORDER BY CASE WHEN tier = 'gold' THEN 0 ELSE 1 END, CASE WHEN length(evidence_text) < 8 THEN 1 ELSE 0 END, length(evidence_text), annotation_id) = 1"),
)
def representative_evidence(spark, d):
    return profile.representative_evidence(star.annotated(spark, d)).select("place_id", "aspect", "sentiment", "tier", "evidence_text", "annotation_id")


@query(
    "evidence_with_companion",
    star.sql(
        """SELECT review_id, annotation_id, line, aspect, sentiment, evidence_text, context FROM annotated JOIN (SELECT review_id, string_agg(companion, ', ' ORDER BY companion) AS context FROM companions GROUP BY 1) USING (review_id)
        WHERE sentiment = 'negative' AND review_id IN (SELECT review_id FROM companions WHERE companion = 'ASIA')"""
    ),
)
def evidence_with_companion(spark, d):
    return profile.evidence(star.annotated(spark, d), star.companions(spark, d), "negative", "ASIA").select("review_id", "annotation_id", "line", "aspect", "sentiment", "evidence_text", "context")


@query("goodness_by_aspect", star.sql("SELECT place_id, aspect, mentions, goodness FROM scored", *star.SCORES[:2]))
def goodness_by_aspect(spark, d):
    return aspects(spark, d).select("place_id", "aspect", "mentions", "goodness")


def _ranking_sql(join: str, more: list[str]) -> str:
    strong = "coalesce(string_agg(aspect, ';' ORDER BY -(weight * (goodness - 50)), aspect) FILTER (goodness >= 60), '')"
    weak = "coalesce(string_agg(aspect, ';' ORDER BY -(weight * (50 - goodness)), aspect) FILTER (goodness <= 40), '')"
    fits = f"fits AS (SELECT place_id, {FIT_SQL} AS fit_raw, {strong} AS strengths, {weak} AS cautions FROM scored {join} GROUP BY 1)"
    return star.sql("SELECT place_id, place_name, category, region, round_even(fit_raw, 1) AS fit, coalesce(reviews, 0) AS reviews, strengths, cautions FROM fits JOIN candidates USING (place_id) LEFT JOIN totals USING (place_id) WHERE fit_raw >= 40", *star.SCORES, *more, fits)


def _ranking(spark, d, w):
    out = ranking.score_places(star.candidates(spark, d), aspects(spark, d), totals(spark, d), w)
    return out.select("place_id", "place_name", "category", "region", "fit", "reviews", F.array_join("strengths", ";").alias("strengths"), F.array_join("cautions", ";").alias("cautions"))


@query("fit_ranking", _ranking_sql("JOIN weights USING (aspect)", [WEIGHTS_SQL]))
def fit_ranking(spark, d):
    """Every place with a sufficient fit under weighted conditions."""
    return _ranking(spark, d, weights(spark, d))


@query("fit_ranking_no_conditions", _ranking_sql("CROSS JOIN (SELECT 1.0::DOUBLE AS weight)", []))
def fit_ranking_no_conditions(spark, d):
    return _ranking(spark, d, None)


@query("fit_ranking_top10", _ranking_sql("JOIN weights USING (aspect)", [WEIGHTS_SQL]) + " ORDER BY fit DESC, reviews DESC, place_id LIMIT 10")
def fit_ranking_top10(spark, d):
    out = ranking.score_places(star.candidates(spark, d), aspects(spark, d), totals(spark, d), weights(spark, d), limit=10)
    return out.select("place_id", "place_name", "category", "region", "fit", "reviews", F.array_join("strengths", ";").alias("strengths"), F.array_join("cautions", ";").alias("cautions"))


SCRAPS = "saved AS (SELECT c_custkey AS place_id, c_nationkey AS traveller FROM customer)"
SCRAP_SQL = star.sql(
    f"""SELECT traveller, place_id, fit, matched, reviews, row_number() OVER (PARTITION BY traveller ORDER BY matched DESC, fit DESC, reviews DESC, place_id) AS rank, {{reason}} FROM (
      SELECT s.traveller, s.place_id, coalesce(round_even(fit, 1), 50) AS fit, coalesce(matched, false) AS matched, coalesce(t.reviews, 0) AS reviews, strengths, cautions
      FROM saved s LEFT JOIN fits USING (place_id) LEFT JOIN totals t USING (place_id))""",
    *star.SCORES, WEIGHTS_SQL, SCRAPS,
    "own AS (SELECT s.*, w.weight AS w, count(w.weight) OVER (PARTITION BY place_id) AS hits FROM scored s LEFT JOIN weights w USING (aspect))",
    "used AS (SELECT *, coalesce(w, 1.0) AS weight FROM own WHERE hits = 0 OR w IS NOT NULL)",
    f"""fits AS (SELECT place_id, {FIT_SQL} AS fit, max(hits > 0) AS matched,
      list(aspect ORDER BY -(weight * (goodness - 50)), aspect) FILTER (goodness >= 60) AS strengths, list(aspect ORDER BY -(weight * (50 - goodness)), aspect) FILTER (goodness <= 40) AS cautions FROM used GROUP BY 1)""",
)
REASON_SQL = """(SELECT CASE WHEN g <> '' AND b <> '' THEN s || ' ' || g || ' 평가가 좋지만 ' || b || '은(는) 아쉽다는 리뷰가 있어요.' WHEN g <> '' THEN s || ' ' || g || ' 평가가 좋아요.'
  WHEN b <> '' THEN s || ' ' || b || '에 대한 아쉬운 리뷰가 있어요.' ELSE '요구사항과 관련된 리뷰가 적어 판단 근거가 부족해요.' END
  FROM (SELECT coalesce(array_to_string(strengths[1:2], ', '), '') AS g, coalesce(array_to_string(cautions[1:2], ', '), '') AS b, CASE WHEN matched THEN '요구사항과 관련해' ELSE '리뷰 전반에서' END AS s)) AS reason"""


@query("scrap_ranking", SCRAP_SQL.replace("{reason}", REASON_SQL))
def scrap_ranking(spark, d):
    """The saved places of every traveller (a nation stands for one)."""
    saved = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_nationkey").alias("traveller"))
    out = ranking.ranked(ranking.score_scraps(saved, aspects(spark, d), totals(spark, d), weights(spark, d)), ["traveller"])
    return out.select("traveller", "place_id", "fit", "matched", "reviews", F.col("rank").cast("long").alias("rank"), ranking.reason(F.col("strengths"), F.col("cautions"), F.col("matched")).alias("reason"))


@query("tag_nulls_last", "SELECT nullif(c_mktsegment, 'BUILDING') AS tag, count(*) AS n, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') ASC NULLS LAST) AS position FROM customer GROUP BY 1")
def tag_nulls_last(spark, d):
    n = table(spark, d, "customer").groupBy(F.expr("nullif(c_mktsegment, 'BUILDING')").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("position", F.expr("row_number() OVER (ORDER BY tag ASC NULLS LAST)").cast("long"))


@query("image_order", "SELECT o_custkey AS place_id, o_orderkey AS image_id, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderpriority, o_orderkey) AS position FROM orders")
def image_order(spark, d):
    images = table(spark, d, "orders").selectExpr("o_custkey AS place_id", "o_orderkey AS image_id", "o_orderstatus = 'F' AS is_main", "o_orderpriority AS sort_order")
    return profile.main_image(images).select("place_id", "image_id", F.col("position").cast("long").alias("position"))


@query("offset_page", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    o = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))


SCRAP_ROWS = "SELECT event_id AS scrap_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS own_place, CASE WHEN event_id % 3 = 1 THEN event_id % 20000 END AS review_id FROM events"


@query("scrap_resolution", f"SELECT scrap_id, coalesce(own_place, o_custkey) AS place_id FROM ({SCRAP_ROWS}) LEFT JOIN orders ON review_id = o_orderkey")
def scrap_resolution(spark, d):
    """Saved rows with a place of their own, a review's, or none."""
    s = table(spark, d, "events").selectExpr("event_id AS scrap_id", "CASE WHEN event_id % 3 = 0 THEN user_id END AS place_id", "CASE WHEN event_id % 3 = 1 THEN event_id % 20000 END AS review_id")
    found, skipped = profile.resolve_scraps(s, star.reviews(spark, d))
    return found.select("scrap_id", "place_id").union(skipped.select("scrap_id", "place_id"))


@query("missing_ids", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_ids(spark, d):
    from cairn.operators.curation import pending

    return pending(table(spark, d, "events").select("user_id").distinct(), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), key="user_id")


@query("vocab_sets", "SELECT p_type AS category, p_size AS aspect, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS allowed FROM part GROUP BY ALL")
def vocab_sets(spark, d):
    from cairn.operators.labels import vocabulary_sets

    v = table(spark, d, "part").selectExpr("p_type AS category", "p_size AS aspect", "p_brand AS attribute")
    return vocabulary_sets(v, ["category", "aspect"], "attribute").withColumn("allowed", F.array_join("allowed", ","))


@query("span_merge", "WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) // 60000000 AS start, epoch_us(ts) // 60000000 + 600 AS stop FROM events), f AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s), i AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f) SELECT user_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY user_id, island")
def span_merge(spark, d):
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    spans = table(spark, d, "events").select("user_id", minute.alias("start"), (minute + 600).alias("stop"))
    return profile.merged_spans(spans, ["user_id"])
