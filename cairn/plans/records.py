"""Queries of record mappers, wishes, validators, plans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import vocab
from cairn.functions import exprs as X
from cairn.functions import requirements
from cairn.operators import checks, curation, labels, profile, ranking
from cairn.operators import records as R
from cairn.plans import analytics, star
from cairn.plans.registry import query
from cairn.session import scratch, table
from cairn.sources import databases, files, rest, sinks
from cairn.streaming import decisions, logs

WISH = "CASE c_custkey % 4 WHEN 0 THEN '부모님과 조용한 곳, 주차는 상관없어요' WHEN 1 THEN '아이와 계단 없이' WHEN 2 THEN '웨이팅 없는 맛집' ELSE '주차는 필요 없고 바다' END"
WISH_ROWS = """(0, 'noise_level', 3.5, '조용함'), (0, 'walking_burden', 2, '부모님'), (0, 'slope_stairs', 2, '부모님'), (0, 'rest_facilities', 2, '부모님'), (0, 'toilet_facilities', 1, '부모님'),
  (1, 'family_friendly', 3, '아이'), (1, 'walking_burden', 5.5, '아이,걷기 부담'), (1, 'slope_stairs', 5.5, '아이,걷기 부담'), (1, 'toilet_facilities', 1.5, '아이'), (2, 'food_quality', 3, '맛'), (2, 'freshness', 1, '맛'),
  (2, 'waiting_time', 4, '웨이팅'), (2, 'serving_speed', 1.5, '웨이팅'), (3, 'scenery', 3, '경치·전망'), (3, 'view_quality', 3, '경치·전망')"""


@query("wish_weights", f"SELECT c_custkey, aspect, weight::DOUBLE AS weight, keywords FROM customer JOIN (VALUES {WISH_ROWS}) v(k, aspect, weight, keywords) ON c_custkey % 4 = k")
def wish_weights(spark, d):
    """Weights of free-text wishes, without what they say does not matter."""
    wishes = table(spark, d, "customer").select("c_custkey", F.expr(WISH).alias("wish"))
    return requirements.wish_weights(wishes, "c_custkey", "wish").withColumn("keywords", F.array_join("keywords", ","))


@query("wish_ignored", "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 3) THEN '주차' ELSE '' END AS ignored FROM customer")
def wish_ignored(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(requirements.ignored_keywords(F.expr(WISH)), ",").alias("ignored"))


@query(
    "wish_ranking",
    star.sql(
        f"SELECT c_custkey, place_id, round_even(fit, 1) AS fit FROM customer JOIN best ON a = 1 + c_custkey % 3 AND b = 1 + c_custkey % 2",
        star.SCORES[0], "scored AS (SELECT *, round_even(50 + (100 * (pos + 0.5::DOUBLE * neu) / (pos + neg + neu) - 50) * (pos + neg + neu) / (pos + neg + neu + 2), 1) AS goodness FROM counts)",
        "w AS (SELECT a, b, CASE WHEN aspect = (SELECT min(aspect) FROM counts) THEN a ELSE b END::DOUBLE AS weight, aspect FROM (SELECT DISTINCT 1 + c_custkey % 3 AS a, 1 + c_custkey % 2 AS b FROM customer), (SELECT unnest([min(aspect), max(aspect)]) AS aspect FROM counts))",
        f"fits AS (SELECT a, b, place_id, {analytics.FIT_SQL} AS fit FROM scored JOIN w USING (aspect) GROUP BY ALL)", "best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY fit DESC, place_id) = 1)",
    ),
)
def wish_ranking(spark, d):
    """The best place of every traveller, who weighs two aspects in a way of their own; those who weigh alike share a ranking."""
    counts = ranking.scored_aspects(ranking.sentiment_pivot(star.annotated(spark, d), ["place_id", "aspect"]))
    who = table(spark, d, "customer").selectExpr("c_custkey", "1 + c_custkey % 3 AS a", "1 + c_custkey % 2 AS b")
    ends = counts.agg(F.min("aspect"), F.max("aspect")).first()
    pairs = F.explode(F.array(F.struct(F.lit(ends[0]).alias("aspect"), F.col("a").cast("double").alias("weight")), F.struct(F.lit(ends[1]).alias("aspect"), F.col("b").cast("double").alias("weight")))).alias("p")
    ways = F.broadcast(who.select("a", "b").distinct().select("a", "b", pairs).select("a", "b", "p.*"))  # six ways, two aspects
    fits = counts.join(ways, "aspect").groupBy("a", "b", "place_id").agg(ranking.fit_column().alias("fit"))
    best = curation.first_wins(fits, ["a", "b"], [F.desc("fit"), "place_id"])
    return who.join(F.broadcast(best), ["a", "b"]).select("c_custkey", "place_id", F.bround("fit", 1).alias("fit"))


ASPECT = "named_struct('category', {c}, 'attribute', {a}, 'sentiment', {s}, 'evidence', {e})"


def label_records(spark, d, aspect: str = "p_brand", attribute: str = "concat('s', p_size % 10)"):
    """A record per order: its lines as labels, the names of its smaller lines as the review."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey AS o_orderkey", "p_type", "p_name", "l_quantity",
        f"named_struct('line', l_linenumber, 'category', {aspect}, 'attribute', {attribute}, 'sentiment', CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'A' THEN 'negative' ELSE CASE WHEN l_quantity > 25 THEN 'neutral' ELSE 'mixed' END END, 'evidence', CASE WHEN l_quantity > 40 THEN concat(p_name, '!') ELSE p_name END) AS a",
    )
    made = li.groupBy("o_orderkey").agg(F.max("p_type").alias("category"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("l_quantity") <= 45, F.col("p_name")))), " ").alias("review"), F.sort_array(F.collect_list("a")).alias("aspects"))
    context = F.expr("CASE WHEN o_orderstatus <> 'P' THEN array('solo', CASE o_orderpriority WHEN '1-URGENT' THEN 'parents' WHEN '2-HIGH' THEN 'couple' ELSE lower(o_orderpriority) END) END")
    return made.join(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("review_id"), "category", "review", context.alias("traveler_context"), F.transform("aspects", lambda a: a.dropFields("line")).alias("aspects"))


def label_sql(aspect: str = "p_brand", attribute: str = "'s' || (p_size % 10)") -> str:
    return f"""l AS (SELECT l_orderkey AS review_id, l_linenumber AS line, p_type, p_name, l_quantity, {aspect} AS category, {attribute} AS attribute, CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'A' THEN 'negative' ELSE CASE WHEN l_quantity > 25 THEN 'neutral' ELSE 'mixed' END END AS sentiment, CASE WHEN l_quantity > 40 THEN p_name || '!' ELSE p_name END AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey),
  made AS (SELECT review_id, max(p_type) AS kind, coalesce(string_agg(DISTINCT p_name, ' ' ORDER BY p_name) FILTER (l_quantity <= 45), '') AS review FROM l GROUP BY 1),
  records AS (SELECT review_id, kind, review, CASE WHEN o_orderstatus <> 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'parents' WHEN '2-HIGH' THEN 'couple' ELSE lower(o_orderpriority) END END AS context FROM made JOIN orders ON o_orderkey = review_id),
  a AS (SELECT l.*, kind, review, row_number() OVER (PARTITION BY review_id ORDER BY line, category, attribute, sentiment, evidence) AS pos FROM l JOIN records USING (review_id)),
  v AS (SELECT DISTINCT p_type AS kind, p_brand AS category, 's' || (p_size % 10) AS attribute FROM part WHERE p_retailprice < 1000),
  j AS (SELECT a.*, EXISTS (FROM v WHERE v.kind = a.kind AND v.category = a.category) AS known, EXISTS (FROM v WHERE v.kind = a.kind AND v.category = a.category AND v.attribute = a.attribute) AS allowed FROM a)"""


def part_vocabulary(spark, d):
    return checks.Vocabulary.of(table(spark, d, "part").where("p_retailprice < 1000").selectExpr("p_type AS category", "p_brand AS aspect", "concat('s', p_size % 10) AS attribute"))


FAULTS = """SELECT review_id, 0 AS pos, 0 AS k, 'context not allowed: ' || context AS m FROM records WHERE context NOT IN ('parents', 'couple') UNION ALL {aspect}
  UNION ALL SELECT review_id, pos, 3, 'sentiment not allowed: ' || sentiment FROM j WHERE sentiment = 'mixed' UNION ALL SELECT review_id, pos, 4, 'evidence not in review: ' || evidence FROM j WHERE NOT contains(review, evidence)"""
PROBLEMS = "WITH {labels}, f AS ({faults}) SELECT r.review_id, coalesce(string_agg(m, '; ' ORDER BY pos, k), '') AS problems FROM records r LEFT JOIN f USING (review_id) GROUP BY 1"
GOLD_ASPECT = "SELECT review_id, pos, 1, 'aspect or attribute not allowed: ' || category || '/' || attribute FROM j WHERE NOT allowed"
DRAFT_ASPECT = "SELECT review_id, pos, 1, 'aspect of another category: ' || kind || '/' || category FROM j WHERE NOT known UNION ALL SELECT review_id, pos, 2, 'attribute not allowed: ' || category || '/' || attribute FROM j WHERE known AND NOT allowed"


@query("gold_problems", PROBLEMS.format(labels=label_sql(), faults=FAULTS.format(aspect=GOLD_ASPECT)))
def gold_problems(spark, d):
    return checks.gold_problems(label_records(spark, d), part_vocabulary(spark, d)).select("review_id", F.array_join("problems", "; ").alias("problems"))


@query("draft_problems", PROBLEMS.format(labels=label_sql(), faults=FAULTS.format(aspect=DRAFT_ASPECT)))
def draft_problems(spark, d):
    return checks.draft_problems(label_records(spark, d), part_vocabulary(spark, d)).select("review_id", F.array_join("problems", "; ").alias("problems"))


@query("missing_drafts", "SELECT coalesce(o_orderkey, l_orderkey) AS number, CASE WHEN o_orderkey IS NULL THEN 'no review' ELSE 'no draft' END AS side FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL")
def missing_drafts(spark, d):
    return checks.missing_drafts(table(spark, d, "orders").where("o_orderstatus <> 'P'").selectExpr("o_orderkey AS number"), table(spark, d, "lineitem").selectExpr("l_orderkey AS number").distinct(), "number")


@query("schema_validity", f"WITH {label_sql()}, bad AS (SELECT DISTINCT review_id FROM j WHERE NOT allowed OR sentiment = 'mixed') SELECT review_id, coalesce(context IN ('parents', 'couple'), false) AND NOT EXISTS (FROM bad WHERE bad.review_id = records.review_id) AS schema_valid FROM records")
def schema_validity(spark, d):
    return checks.schema_valid(label_records(spark, d), part_vocabulary(spark, d))


@query(
    "schema_problem_counts",
    f"""WITH {label_sql()} SELECT 'context not allowed' AS problem, count(*) AS n FROM records WHERE context NOT IN ('parents', 'couple') HAVING count(*) > 0 UNION ALL SELECT 'aspect not of category: ' || kind, count(*) FROM j WHERE NOT known GROUP BY kind
      UNION ALL SELECT 'attribute not of aspect', count(*) FROM j WHERE known AND NOT allowed HAVING count(*) > 0 UNION ALL SELECT 'sentiment not allowed', count(*) FROM j WHERE sentiment = 'mixed' HAVING count(*) > 0""",
)
def schema_problem_counts(spark, d):
    return checks.schema_problems(label_records(spark, d), part_vocabulary(spark, d))


@query(
    "vocabulary_problems",
    """WITH t AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size % 9 <> 0), u AS (SELECT DISTINCT p_type, p_brand, 's' || (p_size % 10) AS v FROM part WHERE p_size > 12)
      SELECT DISTINCT 'aspect without an entry' AS problem, p_type || '/' || p_brand AS name FROM u WHERE NOT EXISTS (FROM t WHERE t.p_type = u.p_type AND t.p_brand = u.p_brand) UNION ALL SELECT 'aspect without attributes', p_type || '/' || p_brand FROM t WHERE NOT EXISTS (FROM u WHERE t.p_type = u.p_type AND t.p_brand = u.p_brand)
      UNION ALL SELECT 'aspect without a name', p_type || '/' || p_brand FROM t WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_retailprice < 901) UNION ALL SELECT DISTINCT 'attribute without a name', v FROM u WHERE v NOT IN (SELECT 's' || (p_size % 10) FROM part WHERE p_retailprice < 901)""",
)
def vocabulary_problems(spark, d):
    part = table(spark, d, "part")
    aspects = part.where("p_size % 9 <> 0").selectExpr("p_type AS category", "p_brand AS aspect").distinct()
    attributes = part.where("p_size > 12").selectExpr("p_type AS category", "p_brand AS aspect", "concat('s', p_size % 10) AS attribute")
    named = part.where("p_retailprice < 901")
    return checks.vocabulary_problems(aspects, attributes, named.selectExpr("p_brand AS aspect"), named.selectExpr("concat('s', p_size % 10) AS attribute"))


@query(
    "label_schema",
    """WITH a AS (SELECT p_type AS category, string_agg(DISTINCT '"' || p_brand || '"', ',' ORDER BY '"' || p_brand || '"') AS names, string_agg(DISTINCT '"s' || (p_size % 10) || '"', ',' ORDER BY '"s' || (p_size % 10) || '"') AS vals FROM part GROUP BY 1)
      SELECT category, '{"type":"object","properties":{"traveler_context":{"type":"array","items":{"type":"string","enum":["couple","family_with_kids","friends","parents","solo"]}},"aspects":{"type":"array","items":{"type":"object","properties":{"category":{"type":"string","enum":[' || names || ']},"attribute":{"type":"string","enum":[' || vals
        || ']},"sentiment":{"type":"string","enum":["negative","neutral","positive"]},"evidence":{"type":"string"}},"required":["category","attribute","sentiment","evidence"]}}},"required":["traveler_context","aspects"]}' AS schema FROM a""",
)
def label_schema(spark, d):
    return checks.label_schema(table(spark, d, "part").selectExpr("p_type AS category", "p_brand AS aspect", "concat('s', p_size % 10) AS attribute"))


@query("pairs_map", "SELECT c_custkey, c_custkey % 9 AS hotel, c_nationkey AS food FROM customer")
def pairs_map(spark, d):
    text = F.concat(F.lit("hotel="), (F.col("c_custkey") % 9).cast("string"), F.lit(" , food ="), F.col("c_nationkey").cast("string"), F.lit(",x=,=3"))
    return table(spark, d, "customer").select("c_custkey", R.pairs_map(text).alias("m")).select("c_custkey", F.col("m")["hotel"].cast("long").alias("hotel"), F.col("m")["food"].alias("food"))


@query("name_parts", "SELECT c_custkey, 'run' || c_custkey AS name, 'a/b=' || c_name AS path, 'n' || c_nationkey AS place, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || '::x' ELSE '' END AS label FROM customer")
def name_parts(spark, d):
    name, path = R.name_and_path(F.concat(F.lit("run"), F.col("c_custkey").cast("string"), F.lit("=a/b="), "c_name"))
    place, label = R.name_and_label(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("::"), "c_mktsegment", F.lit("::x"))).otherwise(F.lit(""))))
    return table(spark, d, "customer").select("c_custkey", name.alias("name"), path.alias("path"), place.alias("place"), label.alias("label"))


@query("place_ids", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'maps:' || c_custkey WHEN 1 THEN 'tour:' || c_custkey END AS place_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS rooms FROM customer")
def place_ids(spark, d):
    key = F.col("c_custkey").cast("string")
    own, other = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("maps:"), key)).otherwise(F.lit(" ")), F.when(F.col("c_custkey") % 3 == 1, key)
    rooms = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.lit("12 rooms"))
    return table(spark, d, "customer").select("c_custkey", R.prefixed_id([("place", own), ("tour", other)]).alias("place_id"), R.whole_number(rooms).alias("rooms"))


@query("metric_lookup", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 1.0 END AS metric FROM events")
def metric_lookup(spark, d):
    value = F.expr("CASE event_id % 4 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN 'true' WHEN 2 THEN '\"text\"' ELSE 'null' END")
    return table(spark, d, "events").select("event_id", R.metric(F.concat(F.lit('{"a": {"b": '), value, F.lit("}}")), "$.a.b").alias("metric"))


@query("location_rows", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 IN (1, 2) THEN c_acctbal END AS lat, CASE WHEN c_custkey % 4 = 1 THEN c_nationkey ELSE 0 END AS review_count, c_custkey % 4 = 0 AS fetched FROM customer")
def location_rows(spark, d):
    place = F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 < 3, F.struct(F.col("c_acctbal").alias("latitude"))).alias("coordinates"), F.when(F.col("c_custkey") % 4 == 1, F.struct(F.col("c_nationkey").alias("count"))).alias("overall_rating"))
    return table(spark, d, "customer").select("c_custkey", R.location_row(F.when(F.col("c_custkey") % 4 != 0, F.to_json(place))).alias("r")).select("c_custkey", "r.name", "r.lat", "r.review_count", "r.fetched")


@query("service_errors", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'stop: LIMIT ' || c_custkey WHEN 1 THEN 'no JSON' END AS error FROM customer")
def service_errors(spark, d):
    text = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('<r><returnAuthMsg>LIMIT ', c_custkey, '</returnAuthMsg></r>') WHEN 1 THEN '<html>' ELSE '{\"ok\": 1}' END")
    return table(spark, d, "customer").select("c_custkey", R.service_error(text).alias("error"))


def plans_sql() -> str:
    """Plans of reviews for two kinds of places, two for each place, as checks.review_plans makes them with seed 7."""
    h = lambda text: f"('0x' || substr(sha256({text}), 1, 8))::BIGINT"
    draw = lambda what, values: f"[{values}][1 + {h(f"'7:{what}:' || item")} % {values.count(',') + 1}]"
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    return f"""places AS (SELECT c_custkey AS place_id, CASE WHEN c_custkey % 3 = 0 THEN 'ECONOMY' ELSE 'PROMO' END AS category FROM customer),
  pl AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('7:' || place_id), place_id) - 1 AS slot, count(*) OVER (PARTITION BY category) AS n FROM places),
  i0 AS (SELECT category, i, 'syn_' || category || '_7_' || lpad(i::VARCHAR, 5, '0') AS item FROM (SELECT category, unnest(range(2 * count(*))) AS i FROM places GROUP BY 1)),
  i1 AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('7:' || item), item) - 1 AS k FROM i0),
  v AS (SELECT p_type AS category, p_brand AS a, list_sort(list(DISTINCT 's' || (p_size % 10))) AS vals FROM part WHERE p_retailprice < 1000 GROUP BY ALL),
  n AS (SELECT item, a, vals, sha256('7:' || item || ':' || a) AS k, row_number() OVER (PARTITION BY item ORDER BY sha256('7:' || item || ':' || a), a) AS r FROM i1 JOIN v USING (category)),
  asp AS (SELECT item, string_agg(a || '=' || vals[1 + ('0x' || substr(k, 1, 8))::BIGINT % len(vals)], ',' ORDER BY r) AS aspects FROM n WHERE r <= {draw('n', '1, 2, 2, 3, 3, 4')} GROUP BY 1),
  plans AS (SELECT item AS review_id, pl.place_id, i1.category, {draw('traveler', "'couple', 'family_with_kids', 'friends', 'parents', 'solo', NULL, NULL")} AS traveler, coalesce(aspects, '') AS aspects, {draw('length', quoted(checks.LENGTHS))} AS length, {draw('tone', quoted(checks.TONES))} AS tone, 700000 + i AS seed
    FROM i1 JOIN pl ON pl.category = i1.category AND pl.slot = i1.k % pl.n LEFT JOIN asp USING (item))"""


def made_plans(spark, d):
    places = table(spark, d, "customer").selectExpr("c_custkey AS place_id", "CASE WHEN c_custkey % 3 = 0 THEN 'ECONOMY' ELSE 'PROMO' END AS category")
    counts = {r.category: 2 * r.n for r in places.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}  # of two categories
    return checks.review_plans(places, part_vocabulary(spark, d), counts, 2, 7)


def pairs(aspects: str):
    return F.array_join(F.transform(aspects, lambda a: F.concat(a.category, F.lit("="), a.attribute)), ",")


@query("review_plans", f"WITH {plans_sql()} FROM plans")
def review_plans(spark, d):
    return made_plans(spark, d).withColumn("aspects", pairs("aspects"))


@query("synthetic_records", f"WITH {plans_sql()} SELECT review_id, place_id, category, true AS synthetic, 'review of ' || place_id AS review, 'm' AS model, seed + 1000000000 * (place_id % 3) AS seed, traveler, aspects, length, tone FROM plans")
def synthetic_records(spark, d):
    """Generated reviews with all that their generation went by; some were written in a second or third attempt."""
    written = made_plans(spark, d).withColumns({"review": F.concat(F.lit("review of "), F.col("place_id").cast("string")), "used_seed": F.col("seed") + F.lit(1_000_000_000) * (F.col("place_id") % 3)})
    r = checks.synthetic_records(written, "m")
    return r.select("review_id", "place_id", "category", "synthetic", "review", "generation.model", "generation.seed", F.col("generation.traveler_context").alias("traveler"), pairs("generation.aspects").alias("aspects"), "generation.length", "generation.tone")


@query("round_robin_places", "WITH p AS (SELECT c_nationkey % 5 AS g, c_custkey AS place_id, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY sha256('w:' || c_custkey), c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey % 5) AS n FROM customer), o AS (SELECT o_orderkey, o_custkey % 5 AS g, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY sha256('w:' || o_orderkey), o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, place_id FROM o JOIN p ON o.g = p.g AND k = i % n")
def round_robin_places(spark, d):
    places = table(spark, d, "customer").selectExpr("c_nationkey % 5 AS g", "c_custkey AS place_id")
    items = table(spark, d, "orders").selectExpr("CAST(o_custkey % 5 AS INT) AS g", "o_orderkey")
    return curation.round_robin(items, "o_orderkey", places, "place_id", "g", "w").select("o_orderkey", "place_id")


@query("search_steps", "WITH s AS (SELECT c_custkey AS place_id, CASE WHEN c_custkey % 4 = 0 THEN 'fetch' WHEN c_custkey % 4 = 1 THEN 'done' END AS step, sum(CASE WHEN c_custkey % 4 > 1 THEN 1 ELSE 0 END) OVER (ORDER BY c_custkey) AS n FROM customer) SELECT place_id, CASE WHEN place_id % 4 = 0 THEN place_id * 10 END AS found_id, coalesce(step, CASE WHEN n <= 40 THEN 'search' ELSE 'wait' END) AS step FROM s")
def search_steps(spark, d):
    c = table(spark, d, "customer")
    found = c.where("c_custkey % 4 = 0").selectExpr("c_custkey AS place_id", "explode(array(c_custkey * 10, c_custkey * 10 + 1)) AS found_id", "1.0D AS km")
    return rest.search_steps(c.selectExpr("c_custkey AS place_id"), c.where("c_custkey % 4 < 2").selectExpr("c_custkey AS place_id"), found, 40)


@query("preference_counts", "SELECT CASE WHEN event_type = 'view' THEN 'none' ELSE event_type END AS choice, count(*) AS n FROM events GROUP BY 1")
def preference_counts(spark, d):
    return R.preference_counts(table(spark, d, "events").withColumn("event_type", F.expr("CASE WHEN event_type <> 'view' THEN event_type WHEN event_id % 2 = 0 THEN '' END")), "event_type", "none")


@query("most_reviewed", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY reviews DESC, place_id) AS rank FROM (SELECT c_mktsegment AS category, c_custkey AS place_id, count(o_orderkey) AS reviews FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)) WHERE rank <= 5")
def most_reviewed(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("place_id")).agg(F.count(F.lit(1)).alias("reviews"))
    return R.most_reviewed(table(spark, d, "customer").selectExpr("c_custkey AS place_id", "c_mktsegment AS category"), counts, "category", 5).select("category", "place_id", "reviews", F.col("rank").cast("long").alias("rank"))


@query("first_evidence", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS shown FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 3) GROUP BY 1")
def first_evidence(spark, d):
    """The first three pieces of evidence of every record."""
    shown = F.slice(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), 1, 3)  # lines of one order
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(shown, lambda x: x.getField("l_partkey").cast("string")), ",").alias("shown"))


@query("candidate_categories", "WITH r AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'lodging' ELSE 'food' END ELSE '' END AS label FROM customer), k AS (SELECT c_nationkey, arg_min(label, c_custkey) FILTER (label <> '') AS known FROM r GROUP BY 1) SELECT c_custkey, CASE coalesce(nullif(label, ''), known) WHEN 'lodging' THEN 'hotel' WHEN 'food' THEN 'restaurant' END AS category FROM r JOIN k USING (c_nationkey)")
def candidate_categories(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", "c_nationkey", "CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'lodging' ELSE 'food' END ELSE '' END AS label")
    words = {w: c for c, ws in vocab.CATEGORY_WORDS.items() for w in ws}
    return R.candidate_categories(rows, "c_nationkey", "label", "c_custkey", X.map_lookup(words, F.col("_label"))).select("c_custkey", "category")


@query("review_only_aspects", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a' ELSE '' END AS kept, c_custkey % 3 = 1 AS positive FROM customer")
def review_only_aspects(spark, d):
    """Aspects with evidence from the review; whether they are all positive."""
    a = lambda c, s, e: ASPECT.format(c=f"'{c}'", a="'v'", s=f"'{s}'", e=f"'{e}'")
    aspects = f"CASE c_custkey % 3 WHEN 0 THEN array({a('a', 'positive', 'x')}, {a('b', 'negative', 'y')}, {a('c', 'neutral', 'place:k=1')}) WHEN 1 THEN array({a('a', 'positive', 'x')}, {a('c', 'neutral', 'place:k=1')}) ELSE array({a('c', 'positive', 'place:k=1')}) END"
    kept = table(spark, d, "customer").select("c_custkey", labels.review_only(F.expr(aspects)).alias("k"))
    return kept.select("c_custkey", F.array_join(F.transform("k", lambda x: x.getField("category")), ",").alias("kept"), labels.positive_only(F.col("k")).alias("positive"))


@query("place_facts_hold", "SELECT c_custkey, c_custkey % 3 = 0 AS holds FROM customer")
def place_facts_hold(spark, d):
    evidence = F.expr("concat('place:parking=', CASE c_custkey % 3 WHEN 0 THEN 'yes=1' WHEN 1 THEN 'no' ELSE '' END)")
    facts = F.expr("CASE WHEN c_custkey % 3 = 2 THEN map('x', '') ELSE map('parking', 'yes=1') END")
    return table(spark, d, "customer").select("c_custkey", labels.place_fact_holds(evidence, facts).alias("holds"))


@query("reason_sentences", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '요구사항과 관련해 a, b 평가가 좋지만 c은(는) 아쉽다는 리뷰가 있어요.' WHEN 1 THEN '리뷰 전반에서 a 평가가 좋아요.' WHEN 2 THEN '요구사항과 관련해 c, d에 대한 아쉬운 리뷰가 있어요.' ELSE '요구사항과 관련된 리뷰가 적어 판단 근거가 부족해요.' END AS reason FROM customer")
def reason_sentences(spark, d):
    good = F.expr("CASE c_custkey % 4 WHEN 0 THEN array('a', 'b', 'x') WHEN 1 THEN array('a') ELSE CAST(array() AS array<string>) END")
    bad = F.expr("CASE c_custkey % 4 WHEN 0 THEN array('c') WHEN 2 THEN array('c', 'd', 'e') ELSE CAST(array() AS array<string>) END")
    return table(spark, d, "customer").select("c_custkey", ranking.reason(good, bad, F.col("c_custkey") % 2 == 0).alias("reason"))


@query("json_slices", """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '{"r": "' || role || '"}' END AS whole, CASE WHEN turn % 3 < 2 THEN '{"r": "' || role || '"}' END AS slice FROM conversations""")
def json_slices(spark, d):
    """The JSON object that a text is, and the one that stands in it."""
    js = F.concat(F.lit('{"r": "'), "role", F.lit('"}'))
    text = F.when(F.col("turn") % 3 == 0, js).when(F.col("turn") % 3 == 1, F.concat(F.lit("so: "), js, F.lit(" done"))).otherwise(F.lit("no } object {"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.json_object(text).alias("whole"), X.json_slice(text).alias("slice"))


@query("guarded_division", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END AS ratio, CASE WHEN l_quantity > 0 THEN round_even(l_linenumber / l_quantity * 100, 1) ELSE 0 END AS percent FROM lineitem")
def guarded_division(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.safe_div(F.col("l_discount"), F.col("l_tax")).alias("ratio"), X.percent(F.col("l_linenumber"), F.col("l_quantity")).alias("percent"))


@query(
    "finalized_records",
    f"""WITH {label_sql("'Brand' || (l_partkey % 2)", "'any'")}, n AS (SELECT *, CASE WHEN length(regexp_replace(evidence, '!$', '')) >= 3 AND contains(review, regexp_replace(evidence, '!$', '')) THEN regexp_replace(evidence, '!$', '') ELSE evidence END AS e FROM a),
      u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY review_id, category, attribute, sentiment ORDER BY length(e), pos) = 1), b AS (SELECT review_id, count(*) AS lines, bool_or(e <> evidence) AS cut, string_agg(evidence, '; ' ORDER BY pos) AS raw FROM n GROUP BY 1)
      SELECT review_id, string_agg(category || '/' || sentiment || '/' || e, '; ' ORDER BY pos) AS aspects, 'test_real_gold' AS split, CASE WHEN any_value(cut) OR count(*) < any_value(lines) THEN any_value(raw) END AS raw FROM u JOIN b USING (review_id) GROUP BY 1""",
)
def finalized_records(spark, d):
    """Approved labels with evidence normalised and repeats left out; what was approved stays beside them where that changed it."""
    r = checks.finalized(label_records(spark, d, "concat('Brand', l_partkey % 2)", "'any'"))
    listed = F.array_join(F.transform("aspects", lambda a: F.concat_ws("/", a.category, a.sentiment, a.evidence)), "; ")
    return r.select("review_id", listed.alias("aspects"), "split", F.array_join(F.transform("label_raw.aspects", lambda a: a.evidence), "; ").alias("raw"))


@query("normalized_tests", "SELECT c_custkey AS record, '깨끗해요' AS evidence, CASE WHEN c_custkey % 2 = 0 THEN 'pending_approval' END AS normalization FROM customer")
def normalized_tests(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey AS record", "CASE WHEN c_custkey % 2 = 0 THEN '전체적으로 깨끗해요.' ELSE '깨끗해요' END AS evidence", "'전체적으로 깨끗해요.' AS review")
    return R.normalized_test(a).select("record", "evidence", "normalization")


# ---- sources and sinks ----


@query("database_round_trip", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def database_round_trip(spark, d):
    """A table written to a database and read back. The database is one of files in the folder that driver and executors share; one behind a server is read by databases.read_database."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    folder = scratch(spark, "db")
    databases.write_shards(rows, folder, "places")
    return databases.read_shards(spark, folder, "places", rows.schema)


@query("jsonl_strict", "SELECT conv_id, turn, text FROM conversations")
def jsonl_strict(spark, d):
    path = scratch(spark, "strict")
    sinks.write_jsonl(table(spark, d, "conversations").select("conv_id", "turn", "text"), path)
    return files.read_jsonl_strict(spark, path, "conv_id long, turn long, text string")


@query("jsonl_permissive", "SELECT 'record' AS kind, count(*) AS n, sum(event_id) AS ids FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'invalid', count(*), NULL FROM events WHERE event_id % 3 <> 0")
def jsonl_permissive(spark, d):
    from pyspark.sql.types import LongType, StructField, StructType

    path = scratch(spark, "permissive")
    line = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"event_id": ', event_id, '}') WHEN 1 THEN '{"other": 1}' ELSE '{"event_id": ' END""")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    good, bad = files.read_jsonl_permissive(spark, path, StructType([StructField("event_id", LongType())]), "event_id")
    return good.agg(F.lit("record").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).union(bad.agg(F.lit("invalid"), F.count(F.lit(1)), F.lit(None).cast("long")))


@query("place_arrays", "SELECT c_custkey AS place_id, CASE WHEN c_custkey % 2 = 0 THEN 'late' ELSE 'early' END AS source FROM customer")
def place_arrays(spark, d):
    """Files of JSON arrays, of which the last one by name wins a place."""
    path = scratch(spark, "arrays")
    c = table(spark, d, "customer").selectExpr("c_custkey AS place_id")
    for name, rows in (("a", c.withColumn("source", F.lit("early"))), ("b", c.where("place_id % 2 = 0").withColumn("source", F.lit("late")))):
        arrays = rows.groupBy(F.floor(F.col("place_id") / 10_000)).agg(F.to_json(F.collect_list(F.struct("place_id", "source"))).alias("value")).select("value")
        arrays.write.option("maxRecordsPerFile", 1).text(f"{path}/{name}")  # a file holds one array
    return files.read_places(spark, f"{path}/*/*.txt", "place_id long, source string")


@query("csv_encodings", "SELECT c_custkey::VARCHAR AS key, '가' || c_name AS name FROM customer")
def csv_encodings(spark, d):
    """CSV files in two encodings, each read in its own."""
    path = scratch(spark, "csv")
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("가"), "c_name").alias("name"))
    rows.write.option("header", True).csv(path)
    return files.read_csv(spark, f"{path}/*.csv")


@query("csv_positional", "SELECT c_custkey::VARCHAR AS id, c_name AS title FROM customer")
def csv_positional(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "customer").select(F.col("c_custkey").alias("첫째"), F.col("c_name").alias("x"), "c_nationkey").write.option("header", True).csv(path)
    return files.read_csv_positional(spark, path, ["id", "title"])


@query("paged_items", "SELECT n_nationkey AS area, CAST(n_nationkey * 13 AS BIGINT) AS items, CAST(greatest(1, ceil(n_nationkey * 13 / 100)) AS BIGINT) AS calls FROM nation WHERE n_nationkey > 0")
def paged_items(spark, d):
    """Items of every area through the paged source, and the calls that they take."""
    rows = rest.PAGE_ROWS

    def counted_pages(request: dict, page: int) -> dict:  # a source of `total` items in pages
        return {"items": [{"id": request["area"] * 1000 + k} for k in range((page - 1) * rows, min(page * rows, request["total"]))], "total": request["total"]}

    areas = [r.n_nationkey for r in table(spark, d, "nation").select("n_nationkey").collect()]  # a fixed dimension
    got = rest.paged(spark, counted_pages, [{"area": a, "total": a * 13} for a in areas])
    per = got.groupBy(F.get_json_object("request", "$.area").cast("int").alias("area")).agg(F.count(F.lit(1)).alias("items"))
    return per.select("area", "items", rest.pages_needed(F.col("items")).cast("long").alias("calls"))


@query("jsonl_rewrite", "SELECT count(*) FILTER (contains(text, 'th')) AS changed, 0::BIGINT AS left_over FROM documents")
def jsonl_rewrite(spark, d):
    """A file with broken byte tokens, kept as it was and written anew with them decoded."""
    rows = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("th"), F.lit("<0x41>")).alias("text"))
    fixed = labels.with_decoded_bytes(rows, "text", "fixed")
    out = scratch(spark, "fixed")
    return sinks.rewrite_fixed(fixed, "text", "fixed", f"{out}/before", f"{out}/after")


@query("cached_responses", "SELECT n_nationkey AS request, 1::BIGINT AS rows FROM nation")
def cached_responses(spark, d):
    """Responses of two runs in a cache that takes each request once."""
    path = scratch(spark, "cache")
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("request"), F.lit(1).alias("page"), F.to_json(F.struct("n_name")).alias("item"))
    rest.write_cache(n.where("request < '5'"), path)
    rest.write_cache(n, path)
    return spark.read.parquet(path).groupBy(F.col("request").cast("int").alias("request")).agg(F.count(F.lit(1)).alias("rows"))


# ---- records in JSON ----

RECORD = """CASE conv_id % 5 WHEN 0 THEN to_json(named_struct('title', role, 'content', text, 'author', 'x')) WHEN 1 THEN to_json(named_struct('name', ' ', 'title', role, 'review', text)) WHEN 2 THEN '{"title": "no text"}' WHEN 3 THEN '[1, 2]' ELSE '{"title": ' END"""


@query("review_rows", "SELECT conv_id, turn, role AS place, nullif(trim(text, E' \\n\\t'), '') AS review, substr(sha1(role || '|' || trim(text, E' \\n\\t')), 1, 12) AS review_id FROM conversations WHERE conv_id % 5 < 2 AND trim(text, E' \\n\\t') <> ''")
def review_rows(spark, d):
    """Reviews from records of two sources, without those that have no text, are no object or are broken."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr(RECORD).alias("js"))
    good, _ = R.convert_each(c, "js", R.review_row(F.col("js"), ["name", "title"], ["review", "content"]), "r")
    return good.select("conv_id", "turn", "r.place", "r.review", "r.review_id")


@query("broken_records", "SELECT CASE conv_id % 5 WHEN 3 THEN 'no object' ELSE 'no JSON' END AS error, count(*) AS n FROM conversations WHERE conv_id % 5 > 2 GROUP BY 1")
def broken_records(spark, d):
    c = table(spark, d, "conversations").select(F.expr(RECORD).alias("js"))
    _, bad = R.convert_each(c, "js", R.review_row(F.col("js"), ["name", "title"], ["review", "content"]), "r")
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("label_aspects", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{"category":"a"};{"category":"b"}' ELSE '' END AS aspects FROM customer""")
def label_aspects(spark, d):
    js = F.expr("""CASE c_custkey % 4 WHEN 0 THEN '{"aspects": [{"category": "a"}, 3, "x", {"category": "b"}]}' WHEN 1 THEN '{"aspects": {"category": "a"}}' WHEN 2 THEN '"text"' ELSE 'broken {' END""")
    return table(spark, d, "customer").select("c_custkey", F.array_join(R.label_aspects(js), ";").alias("aspects"))


@query("keyed_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def keyed_state(spark, d):
    """State of users in a versioned table, updated by two runs over what came in between."""
    root = scratch(spark, "state")
    e = table(spark, d, "events")
    half = e.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    state = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    logs.update_state(state(e.where(F.col("ts") <= F.lit(half))), root, "user_id")
    return logs.update_state(state(e.where(F.col("ts") > F.lit(half))), root, "user_id")


@query(
    "detail_with_profile",
    star.sql("SELECT c.place_id, place_name, category, district, coalesce(n, 0) AS reviews FROM candidates c LEFT JOIN (SELECT place_id, count(*) AS n FROM reviews GROUP BY 1) USING (place_id)"),
)
def detail_with_profile(spark, d):
    """A place's detail and profile in one row."""
    c = star.candidates(spark, d)
    p = profile.place_profile(c.select("place_id"), star.reviews(spark, d), star.annotated(spark, d), star.companions(spark, d))
    return c.join(p, "place_id", "left").select("place_id", "place_name", "category", "district", F.coalesce("reviews", F.lit(0)).alias("reviews"))


@query(
    "condition_payload",
    """WITH c AS (SELECT c_custkey, lower(nullif(c_mktsegment, 'HOUSEHOLD')) AS w, CASE WHEN c_acctbal < 0 THEN 'low' END AS walk, CASE WHEN c_nationkey % 2 = 0 THEN '"n' || c_nationkey || '","' || c_mktsegment || '"' ELSE '' END AS pri, CASE WHEN c_acctbal > 5000 THEN '"stairs"' ELSE '' END AS avoid, nullif(c_mktsegment, 'MACHINERY') AS category FROM customer)
      SELECT c_custkey, '{"with":' || coalesce('"' || w || '"', 'null') || ',"walk":' || coalesce('"' || walk || '"', 'null') || ',"pri":[' || pri || '],"avoid":[' || avoid || '],"category":' || coalesce('"' || category || '"', 'null') || '}' AS payload FROM c""",
)
def condition_payload(spark, d):
    """The conditions of a search as JSON, with what is not asked for."""
    c = table(spark, d, "customer")
    pri, avoid = F.expr("CASE WHEN c_nationkey % 2 = 0 THEN array(concat('n', c_nationkey), c_mktsegment) ELSE CAST(array() AS array<string>) END"), F.expr("CASE WHEN c_acctbal > 5000 THEN array('stairs') ELSE CAST(array() AS array<string>) END")
    payload = checks.condition_payload(F.expr("lower(nullif(c_mktsegment, 'HOUSEHOLD'))"), F.expr("CASE WHEN c_acctbal < 0 THEN 'low' END"), pri, avoid, F.expr("nullif(c_mktsegment, 'MACHINERY')"))
    return c.select("c_custkey", payload.alias("payload"))


# ---- decisions, guarded calls, details, sheets, reviews of all sources ----

DECISIONS_SQL = f"""{label_sql()}, log AS (SELECT event_id, user_id * 13 AS review_id, ts, event_type, value FROM events),
  ok AS (SELECT log.*, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'discard' ELSE 'reset' END AS action FROM log JOIN records USING (review_id) WHERE event_type <> 'purchase' OR value <= 60),
  state AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ts DESC, event_id DESC) = 1)"""


def decision_log(spark, d):
    """Events as decisions on every 13th order: a purchase approves the draft's label without its aspects, or with a made-up one."""
    return table(spark, d, "events").selectExpr(
        "event_id", "user_id * 13 AS review_id", "ts AS at", "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'discard' ELSE 'reset' END AS action", "concat('r', event_id % 3) AS reviewer", "props AS note",
        "CASE WHEN event_type = 'purchase' THEN array('solo') END AS traveler_context",
        "CASE WHEN event_type = 'purchase' THEN IF(value > 60, array(named_struct('category', 'none', 'attribute', 'none', 'sentiment', 'positive', 'evidence', '')), CAST(array() AS array<struct<category: string, attribute: string, sentiment: string, evidence: string>>)) END AS aspects",
    )


@query("decision_states", f"WITH {DECISIONS_SQL} SELECT r.review_id, CASE action WHEN 'approve' THEN 'gold' WHEN 'discard' THEN 'discarded' ELSE 'pending' END AS status, CASE WHEN action IN ('approve', 'discard') THEN event_id END AS event_id FROM records r LEFT JOIN state USING (review_id)")
def decision_states(spark, d):
    """Status of every draft after all decisions; approvals of labels with faults count for nothing."""
    silver = label_records(spark, d)
    state = decisions.latest(decisions.judged(decision_log(spark, d), silver, part_vocabulary(spark, d)))
    return decisions.statuses(state, silver).join(state.where("action <> 'reset'").select("review_id", "event_id"), "review_id", "left")


@query("decided_gold", f"WITH {DECISIONS_SQL} SELECT review_id, 'gold' AS tier, 'r' || (event_id % 3) AS reviewer, true AS edited FROM state WHERE action = 'approve'")
def decided_gold(spark, d):
    silver = label_records(spark, d)
    state = decisions.latest(decisions.judged(decision_log(spark, d), silver, part_vocabulary(spark, d)))
    return decisions.gold(state, silver).select("review_id", "tier", "decision.reviewer", "decision.edited")


@query(
    "guarded_calls",
    """WITH n AS (SELECT *, value < 20 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), r AS (SELECT *, bad AND coalesce(lag(bad, 1) OVER w, false) AND coalesce(lag(bad, 2) OVER w, false) AS third FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      s AS (SELECT user_id, min(i) FILTER (third) AS stop FROM r GROUP BY 1)
      SELECT event_id, CASE WHEN i > least(coalesce(stop, 60), 60) THEN 'stopped' WHEN bad THEN 'failed' ELSE 'ok' END AS status, CASE WHEN i > least(coalesce(stop, 60), 60) THEN CASE WHEN stop < 60 THEN '3 failures in a row' ELSE 'budget of 60 calls' END WHEN bad THEN 'no answer' END AS error FROM r JOIN s USING (user_id)""",
)
def guarded_calls(spark, d):
    """Calls of every source until its budget is spent or three in a row have failed."""

    def answer(request: dict) -> str:
        if request["value"] < 20:
            raise ValueError("no answer")
        return f"value {request['value']}"

    requests = table(spark, d, "events").select("event_id", "user_id", "value")
    return rest.guarded(requests, answer, "user_id", ["event_id"], budget=60)[0].select("event_id", "status", "error")


@query("enriched_places", "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN 'parking ' || (o_custkey % 3) END AS detail FROM orders")
def enriched_places(spark, d):
    """Orders with what a lookup says of their customer; half of the keys are in the cache from a run before."""

    def fetch(keys: list) -> dict:
        return {k: f"parking {k % 3}" for k in keys if k % 7}

    path, orders = scratch(spark, "details"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rest.with_details(orders.where("o_custkey % 2 = 0"), "o_custkey", fetch, path, "long")
    return rest.with_details(orders, "o_custkey", fetch, path, "long").select("o_orderkey", "detail")


@query(
    "review_records",
    """SELECT CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'maps' ELSE 'tour' END || '_' || (conv_id * 100 + turn) ELSE 'p' || conv_id || '#' || turn END AS review_id, 'p' || conv_id AS place_id, CASE WHEN conv_id % 2 = 0 THEN 'maps' ELSE 'tour' END AS source, trim(text, E' \n\t') AS review, CASE WHEN turn % 3 = 0 THEN turn::VARCHAR END AS rating, role AS trip_type, CASE WHEN turn % 3 = 1 THEN 'd' || turn END AS published, turn % 5 = 0 AS translated
      FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at FROM conversations) WHERE trim(text, E' \n\t') <> ''""",
)
def review_records(spark, d):
    """Reviews within places, under the names of several sources, as records of one form."""
    c = table(spark, d, "conversations")
    text = [F.when(F.pmod(F.col("turn"), F.lit(4)) == i, F.col("text")).alias(n) for i, n in enumerate(R.REVIEW_TEXT_FIELDS)]
    review = F.to_json(F.struct(*text, F.when(F.col("turn") % 2 == 0, F.col("conv_id") * 100 + F.col("turn")).alias("review_id"), F.when(F.col("turn") % 3 == 0, F.col("turn")).alias("rating"), F.col("role").alias("trip_type"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("d"), F.col("turn").cast("string"))).alias("publish_ts"), F.lit("ko").alias("language"), F.when(F.col("turn") % 5 == 0, "en").alias("source_language")))
    listed = c.select("conv_id", "turn", review.alias("r")).groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "r"))), lambda x: x.getField("r")), ","), F.lit("]")).alias("reviews"))
    places = listed.select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("place_id"), F.lit("hotel").alias("category"), F.array(F.when(F.col("conv_id") % 2 == 0, "maps").otherwise("tour"), F.lit("other")).alias("sources"), "reviews")
    return R.review_records(places).select("review_id", "place_id", "source", "review", "rating", "trip_type", "published", "translated")
