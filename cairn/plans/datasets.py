"""Queries of dataset assembly and the smaller lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import curation, datasets
from cairn.plans import analytics, star
from cairn.plans.registry import query
from cairn.session import table


@query("split_router", "SELECT o_orderkey AS review_id, o_custkey AS place_id, CASE WHEN c_nationkey < 15 THEN 'train' ELSE 'val' END AS split FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20")
def split_router(spark, d):
    splits = table(spark, d, "customer").selectExpr("c_custkey AS place_id", "CASE WHEN c_nationkey < 15 THEN 'train' WHEN c_nationkey < 20 THEN 'val' ELSE 'test' END AS split")
    return datasets.route_splits(table(spark, d, "orders").selectExpr("o_orderkey AS review_id", "o_custkey AS place_id"), splits).select("review_id", "place_id", "split")


@query("gold_guard", "SELECT l_orderkey AS review_id, 'gold' AS tier, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def gold_guard(spark, d):
    rows = table(spark, d, "lineitem").where("l_linestatus = 'F'").selectExpr("l_orderkey AS review_id", "'gold' AS tier")
    return datasets.gold_only(rows).groupBy("review_id", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unified_dataset",
    r"""WITH s AS (SELECT CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS rank, doc_id, source, text FROM documents), k AS (SELECT * FROM s WHERE source NOT IN ('src1', 'src2') QUALIFY row_number() OVER (PARTITION BY source, trim(text, E' \n\t') ORDER BY rank, doc_id) = 1)
      SELECT doc_id, source, CASE WHEN source IN ('src3', 'src4') THEN 'val' ELSE 'train' END AS split, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS aspects FROM k""",
)
def unified_dataset(spark, d):
    aspects = F.array(F.struct(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 5)).otherwise("place:a=b").alias("evidence")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("place_id"), F.col("text").alias("review"), "lang", aspects.alias("aspects"))
    splits = docs.select("place_id").distinct().withColumn("split", F.when(F.col("place_id").isin("src1", "src2"), "test").when(F.col("place_id").isin("src3", "src4"), "val").otherwise("train"))
    u = datasets.unify([docs.where("lang <> 'en'"), docs.where("lang = 'en'")], splits, ("train", "val"))
    return u.select(F.col("pos").alias("doc_id"), F.col("place_id").alias("source"), "split", F.size("aspects").cast("long").alias("aspects"))


@query(
    "selected_reviews",
    """WITH f AS (SELECT doc_id, text, source, lang, CASE WHEN length(text) < 10 OR NOT regexp_matches(text, '[가-힣a-z]') THEN 'short' WHEN count(*) OVER (PARTITION BY text) >= 3 THEN 'template' END AS r FROM documents),
      k AS (SELECT * FROM f WHERE r IS NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1), b AS (SELECT *, CASE WHEN regexp_matches(text, 'anon') THEN 'not_positive' WHEN regexp_matches(text, 'ing') THEN 'rich' ELSE 'plain' END AS bucket FROM k),
      c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY list_position(['not_positive', 'rich', 'plain'], bucket), sha256('r:' || CAST(doc_id AS VARCHAR)), doc_id) <= 30),
      e AS (SELECT *, count(*) FILTER (bucket <> 'plain') OVER (PARTITION BY lang) AS rich, row_number() OVER (PARTITION BY lang, bucket = 'plain' ORDER BY sha256('r:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM c)
      SELECT doc_id, bucket FROM e WHERE bucket <> 'plain' OR rn <= CAST(trunc(rich * 0.4::DOUBLE / (1 - 0.4::DOUBLE)) AS INT)""",
)
def selected_reviews(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("name"), F.col("lang").alias("label"), F.col("text").alias("review"), F.col("lang").alias("category"))
    bucket = F.when(F.col("review").contains("anon"), "not_positive").when(F.col("review").contains("ing"), "rich").otherwise("plain")
    return datasets.select_reviews(rows, bucket, 30, 0.4, "r").select(F.col("pos").alias("doc_id"), "bucket")


@query("labels_by_name", "SELECT source, arg_min(CASE lang WHEN 'de' THEN NULL ELSE lang END, doc_id) FILTER (lang <> 'de') AS known_label FROM documents GROUP BY 1 HAVING count(*) FILTER (lang <> 'de') > 0")
def labels_by_name(spark, d):
    docs = table(spark, d, "documents").withColumn("label", F.when(F.col("lang") != "de", F.col("lang")).otherwise(""))
    return datasets.first_labels(docs, "source", "label", "doc_id")


@query("length_batches", "SELECT doc_id, level, (row_number() OVER (PARTITION BY level ORDER BY length(text), doc_id) - 1) // 16 AS batch FROM (SELECT *, CAST(floor(log2(length(text) + 1)) AS INT) AS level FROM documents)")
def length_batches(spark, d):
    return datasets.length_batches(table(spark, d, "documents"), "text", 16, "doc_id").select("doc_id", "level", "batch")


@query("sft_examples", "SELECT conv_id, turn, 'label the review' AS system, text AS review, '{\"role\":\"' || role || '\"}' AS completion FROM conversations")
def sft_examples(spark, d):
    e = table(spark, d, "conversations").select("conv_id", "turn", datasets.sft_example("label the review", F.col("text"), F.struct("role")).alias("e"))
    return e.select("conv_id", "turn", F.col("e.prompt")[0].content.alias("system"), F.col("e.prompt")[1].content.alias("review"), "e.completion")


@query("interpreted_weights", "SELECT user_id, event_type AS aspect, 3.0::DOUBLE AS weight FROM events GROUP BY ALL HAVING NOT max(value < 5)")
def interpreted_weights(spark, d):
    items = table(spark, d, "events").select("user_id", F.col("event_type").alias("aspect"), F.when(F.col("value") < 5, "neutral").otherwise("positive").alias("sentiment"))
    return datasets.important_aspects(items, ["user_id"])


@query(
    "model_compare",
    star.sql(
        f"SELECT tier, place_id, round_even(fit_raw, 1) AS fit, reviews FROM (SELECT tier, place_id, {analytics.FIT_SQL} AS fit_raw FROM sc JOIN weights USING (aspect) GROUP BY ALL) JOIN totals USING (place_id) WHERE fit_raw >= 40",
        star.SCORES[2], analytics.WEIGHTS_SQL, "c AS (SELECT tier, place_id, aspect, count(*) FILTER (sentiment = 'positive') AS pos, count(*) FILTER (sentiment = 'negative') AS neg, count(*) FILTER (sentiment = 'neutral') AS neu FROM annotated GROUP BY ALL)",
        "sc AS (SELECT *, round_even(50 + (100 * (pos + 0.5::DOUBLE * neu) / (pos + neg + neu) - 50) * (pos + neg + neu) / (pos + neg + neu + 2), 1) AS goodness FROM c)",
    ),
)
def model_compare(spark, d):
    """The ranking under each of two label sets."""
    return datasets.compare_conditions(star.annotated(spark, d), analytics.totals(spark, d), analytics.weights(spark, d), ["tier"])


@query("first_language_text", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS name FROM part")
def first_language_text(spark, d):
    """The name in the wanted language, else the first name, else none."""
    entry = lambda lang, c: F.struct(F.lit(lang).alias("lang"), F.col(c).alias("name"))
    none = F.array().cast("array<struct<lang:string,name:string>>")
    names = F.when(F.col("p_size") % 2 == 0, F.array(entry("en", "p_name"), entry("ko", "p_brand"))).when(F.col("p_size") % 3 == 0, none).otherwise(F.array(entry("en", "p_name"), entry("ja", "p_brand")))
    return table(spark, d, "part").select("p_partkey", datasets.first_in(names, lambda n: n.lang == "ko").getField("name").alias("name"))


@query("sha_ids", "SELECT c_custkey, 'c_' || substr(sha1(c_name || '|' || c_mktsegment), 1, 10) AS id, CASE WHEN regexp_matches(CAST(c_nationkey AS VARCHAR), '^\\d+$') THEN c_nationkey END AS rooms FROM customer")
def sha_ids(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.concat(F.lit("c_"), F.substring(F.sha1(F.concat("c_name", F.lit("|"), "c_mktsegment")), 1, 10)).alias("id"), F.when(F.col("c_nationkey").cast("string").rlike(r"^\d+$"), F.col("c_nationkey")).alias("rooms"))


@query("page_with_total", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 20")
def page_with_total(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.orderBy("c_name", "c_custkey").offset(20).limit(20).withColumn("total", F.lit(c.count()).cast("long"))


@query("normalized_lookup", "SELECT c_custkey, n_nationkey FROM customer JOIN nation ON lower(trim('  ' || upper(n_name) || ' ')) = lower(n_name) AND c_nationkey = n_nationkey")
def normalized_lookup(spark, d):
    n = table(spark, d, "nation").where(F.lower(F.trim(F.concat(F.lit("  "), F.upper("n_name"), F.lit(" ")))) == F.lower("n_name"))
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey")


@query("area_contains", "SELECT c_custkey, contains(lower(c_name || ' ' || n_name), 'an') OR contains(lower(c_name || ' ' || n_name), 'land') AS inside FROM customer JOIN nation ON c_nationkey = n_nationkey")
def area_contains(spark, d):
    """Whether one of an area's aliases is part of the joined addresses."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    address = F.lower(F.concat_ws(" ", "c_name", "n_name"))
    return c.select("c_custkey", F.exists(F.array(F.lit("an"), F.lit("land")), lambda a: F.contains(address, a)).alias("inside"))


@query("null_safe_match", "SELECT a.event_id, count(b.event_id) AS partners FROM (SELECT event_id, user_id, nullif(event_type, 'view') AS k FROM events) a LEFT JOIN (SELECT event_id, user_id, nullif(event_type, 'view') AS k FROM events WHERE value > 90) b ON a.user_id = b.user_id AND a.k IS NOT DISTINCT FROM b.k GROUP BY 1")
def null_safe_match(spark, d):
    """Keys with a null equal each other; counted before the join, so no pairs are made."""
    e = table(spark, d, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("view")).alias("k"), "value")
    n = e.where("value > 90").groupBy(F.col("user_id").alias("u"), F.col("k").alias("kk")).agg(F.count(F.lit(1)).alias("partners"))
    return e.join(n, (F.col("user_id") == F.col("u")) & F.col("k").eqNullSafe(F.col("kk")), "left").select("event_id", F.coalesce("partners", F.lit(0)).alias("partners"))


@query("interval_clamp", "SELECT doc_id, least(greatest(n_chars - 100, 0), length(text)) AS start, least(greatest(n_chars + 50, least(greatest(n_chars - 100, 0), length(text))), length(text)) AS stop FROM documents")
def interval_clamp(spark, d):
    n = F.length("text").cast("long")
    start = F.least(F.greatest(F.col("n_chars") - 100, F.lit(0)), n)
    return table(spark, d, "documents").select("doc_id", start.alias("start"), F.least(F.greatest(F.col("n_chars") + 50, start), n).alias("stop"))


@query("rank_first_wins_union", "SELECT k, v FROM (SELECT c_mktsegment AS k, c_custkey AS v, 0 AS s FROM customer UNION ALL SELECT o_orderpriority, o_orderkey, 1 FROM orders) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s, v) = 1")
def rank_first_wins_union(spark, d):
    """Sources are joined end to end; the first source, then the first row, wins a key."""
    a = table(spark, d, "customer").selectExpr("c_mktsegment AS k", "c_custkey AS v", "0 AS s")
    b = table(spark, d, "orders").selectExpr("o_orderpriority AS k", "o_orderkey AS v", "1 AS s")
    return curation.first_wins(a.unionByName(b), ["k"], ["s", "v"]).select("k", "v")
