"""Queries of evaluation, error analysis, audits and append logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.exprs import char_iou, overlaps
from cairn.operators import curation
from cairn.operators import evaluation as E
from cairn.operators.curation import pending
from cairn.plans.registry import query
from cairn.session import table, tasks_for
from cairn.streaming import logs

GP = "WITH r AS (SELECT l_orderkey AS id, l_linenumber % 2 AS side, p_type AS category, l_returnflag AS sentiment FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT id, category, sentiment, count(*) FILTER (side = 0) AS g, count(*) FILTER (side = 1) AS p FROM r GROUP BY ALL)"
PRF = "round_even(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round_even(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall, round_even(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 4) AS f1"


def sides(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS id", "l_linenumber % 2 AS side", "p_type AS category", "l_returnflag AS sentiment", "l_partkey AS pos", "p_brand AS attribute", "p_name AS evidence")
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


@query("multiset_prf", f"{GP}, c AS (SELECT sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM k) SELECT tp, fp, fn, {PRF} FROM c")
def multiset_prf(spark, d):
    gold, predicted = sides(spark, d)
    return E.prf(E.multiset_counts(gold, predicted, "id", ["category", "sentiment"], tasks_for(table(spark, d, "lineitem"))), [])


@query("context_prf", f"{GP}, s AS (SELECT DISTINCT id, category, side FROM r), x AS (SELECT category, id, max(side = 0) AS g, max(side = 1) AS p FROM s GROUP BY ALL), c AS (SELECT category, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM x GROUP BY 1) SELECT category, tp, fp, fn, {PRF} FROM c")
def context_prf(spark, d):
    """The same by category, for sets instead of multisets."""
    tasks = tasks_for(table(spark, d, "lineitem"))
    gold, predicted = (x.select("id", "category").repartition(tasks, "id").distinct() for x in sides(spark, d))
    by = E.multiset_counts(gold.withColumn("key", F.concat_ws("|", "id", "category")), predicted.withColumn("key", F.concat_ws("|", "id", "category")), "key", ["category"], tasks)
    return E.prf(by.withColumn("category", F.split_part("key", F.lit("|"), F.lit(2))), ["category"])


@query("record_exact_match", f"{GP} SELECT id, bool_and(g = p) AS exact FROM k GROUP BY 1")
def record_exact_match(spark, d):
    gold, predicted = sides(spark, d)
    return E.multiset_counts(gold, predicted, "id", ["category", "sentiment"], tasks_for(table(spark, d, "lineitem"))).select("id", (F.col("fp") + F.col("fn") == 0).alias("exact"))


@query(
    "char_iou",
    """WITH s AS (SELECT doc_id, text, substr(text, 5, 20) AS a, CASE doc_id % 3 WHEN 0 THEN substr(text, 12, 20) WHEN 1 THEN 'no such words' ELSE substr(text, 5, 20) END AS b FROM documents),
      p AS (SELECT *, instr(text, a) AS s1, instr(text, b) AS s2, length(a) AS n1, length(b) AS n2 FROM s)
      SELECT doc_id, round_even(CASE WHEN n1 * n2 = 0 THEN 0 WHEN s1 = 0 OR s2 = 0 THEN (a = b)::INT ELSE greatest(least(s1 + n1, s2 + n2) - greatest(s1, s2), 0) / (greatest(s1 + n1, s2 + n2) - least(s1, s2)) END, 6) AS iou,
        s1 > 0 AND s2 > 0 AND s1 < s2 + n2 AND s2 < s1 + n1 AS overlapping FROM p""",
)
def char_iou_query(spark, d):
    a = F.substring("text", 5, 20)
    b = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 12, 20)).when(F.col("doc_id") % 3 == 1, "no such words").otherwise(a)
    s = table(spark, d, "documents").select("doc_id", "text", a.alias("a"), b.alias("b"))
    return s.select("doc_id", F.bround(char_iou(F.col("a"), F.col("b"), F.col("text")), 6).alias("iou"), overlaps(F.col("a"), F.col("b"), F.col("text")).alias("overlapping"))


GREEDY = """WITH RECURSIVE r AS (SELECT l_orderkey AS id, l_linenumber % 2 AS side, l_partkey AS pos, p_type AS category, l_returnflag AS sentiment, p_brand AS attribute, p_name AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey),
  n AS (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY pos, category, attribute, sentiment, evidence) AS k FROM r),
  t AS (SELECT id, string_agg(DISTINCT evidence, ' ' ORDER BY evidence) AS text FROM r GROUP BY 1),
  s AS (SELECT n.*, instr(text, evidence) AS s, length(evidence) AS len FROM n JOIN t USING (id)),
  refs AS (SELECT g.id, g.k, {same} FROM s g {join} WHERE g.side = 0),
  pairs AS (SELECT g.id, g.k, p.k AS i, max(CASE WHEN g.len = 0 OR p.len = 0 THEN 0 WHEN g.s = 0 OR p.s = 0 THEN (g.evidence = p.evidence)::INT
      ELSE greatest(least(g.s + g.len, p.s + p.len) - greatest(g.s, p.s), 0) / (greatest(g.s + g.len, p.s + p.len) - least(g.s, p.s)) END) AS v
    FROM refs g JOIN s p ON p.side = 1 AND p.id = g.id AND p.category = g.category AND p.sentiment = g.sentiment GROUP BY ALL),
  gold AS (SELECT g.id, g.k, coalesce(list(pairs.i ORDER BY v DESC, pairs.i DESC) FILTER (v >= 0.5), []) AS choices FROM n g LEFT JOIN pairs ON pairs.id = g.id AND pairs.k = g.k WHERE g.side = 0 GROUP BY ALL),
  fold(id, k, used) AS (SELECT DISTINCT id, 0::BIGINT, []::BIGINT[] FROM r UNION ALL
    SELECT f.id, g.k, CASE WHEN len(list_filter(g.choices, lambda c: NOT list_contains(f.used, c))) > 0 THEN list_append(f.used, list_filter(g.choices, lambda c: NOT list_contains(f.used, c))[1]) ELSE f.used END FROM fold f JOIN gold g ON g.id = f.id AND g.k = f.k + 1),
  tp AS (SELECT id, max(len(used)) AS tp FROM fold GROUP BY 1)
  SELECT id AS review_id, tp::BIGINT AS tp, count(*) FILTER (side = 1) - tp AS fp, count(*) FILTER (side = 0) - tp AS fn FROM n JOIN tp USING (id) GROUP BY id, tp"""


def span_records(spark, d):
    """Labels of even lines as Gold, of odd lines as predictions, in the text of the order's parts."""
    gold, predicted = sides(spark, d)
    pack = lambda df, name: df.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "category", "attribute", "sentiment", "evidence"))), lambda x: F.struct(x.category.alias("category"), F.lit("any").alias("attribute"), x.sentiment.alias("sentiment"), x.evidence.alias("evidence"))).alias(name))
    text = gold.union(predicted).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("evidence")), " ").alias("review"))
    return text.join(pack(gold, "gold"), "id", "left").join(pack(predicted, "predicted"), "id", "left").withColumnRenamed("id", "review_id")


@query("greedy_overlap", GREEDY.format(same="g.category, g.sentiment, g.evidence, g.s, g.len", join=""))
def greedy_overlap(spark, d):
    """One-to-one span matches: every Gold label takes the free prediction that overlaps it most."""
    return E.greedy_overlap(span_records(spark, d))


@query("greedy_references", GREEDY.format(same="g.category, g.sentiment, x.evidence, x.s, x.len", join="JOIN s x ON x.id = g.id AND x.category = g.category AND x.sentiment = g.sentiment AND (x.side = 0 OR x.pos % 3 = 0)"))
def greedy_references(spark, d):
    """The same where any evidence that the Gold labels, or raw ones beside them, have for a key will do."""
    records = span_records(spark, d)
    gold, predicted = sides(spark, d)
    raw = predicted.where("pos % 3 = 0").groupBy("id").agg(F.collect_list(F.struct("category", F.lit("any").alias("attribute"), "sentiment", "evidence")).alias("raw"))
    return E.greedy_overlap(records.join(raw, records.review_id == raw.id, "left"), raw="raw")


UNMATCHED = """WITH r AS (SELECT l_orderkey AS id, l_linenumber % 2 AS side, l_partkey AS pos, p_type AS category, p_brand AS attribute, l_returnflag AS sentiment, p_name AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey),
  n AS (SELECT *, row_number() OVER (PARTITION BY side, id, category, sentiment ORDER BY pos) AS k FROM r), g AS (SELECT * FROM n WHERE side = 0), p AS (SELECT * FROM n WHERE side = 1)"""


@query(
    "error_taxonomy",
    f"""{UNMATCHED}, x AS (SELECT p.* FROM p WHERE NOT EXISTS (FROM g WHERE g.id = p.id AND g.category = p.category AND g.sentiment = p.sentiment AND g.k = p.k)), t AS (SELECT id, string_agg(DISTINCT evidence, ' ' ORDER BY evidence) AS text FROM r GROUP BY 1)
      SELECT CASE WHEN category = 'PROMO' THEN 'unknown aspect' WHEN category = 'ECONOMY' THEN 'aspect of another category' WHEN attribute = 'Brand#1' THEN 'unknown attribute'
        WHEN EXISTS (FROM g WHERE g.id = x.id AND g.category = x.category AND g.sentiment = x.sentiment) THEN 'repeats a Gold label' WHEN NOT EXISTS (FROM g WHERE g.id = x.id) THEN 'no Gold label at all'
        WHEN EXISTS (FROM g WHERE g.id = x.id AND g.category = x.category) THEN 'other attribute or sentiment'
        WHEN EXISTS (FROM g WHERE g.id = x.id AND instr(text, g.evidence) > 0 AND instr(text, x.evidence) > 0 AND instr(text, g.evidence) < instr(text, x.evidence) + length(x.evidence) AND instr(text, x.evidence) < instr(text, g.evidence) + length(g.evidence)) THEN 'same evidence, other aspect'
        ELSE 'evidence without a Gold label' END AS kind, count(*) AS n FROM x JOIN t USING (id) GROUP BY 1""",
)
def error_taxonomy(spark, d):
    gold, predicted = sides(spark, d)
    keys = ["category", "sentiment"]
    extra, _ = E.unmatched(gold, predicted, "id", keys)
    texts = gold.union(predicted).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("evidence")), " ").alias("text"))
    flagged = E.overlapping_gold(extra, gold, texts, "id")
    flagged = flagged.join(gold.select("id", *keys).distinct().withColumn("same", F.lit(True)), ["id", *keys], "left").join(gold.select("id", "category").distinct().withColumn("name", F.lit(True)), ["id", "category"], "left").join(gold.select("id").distinct().withColumn("any", F.lit(True)), "id", "left")
    kind = E.extra_kind(F.col("category") != "PROMO", F.col("category") != "ECONOMY", F.col("attribute") != "Brand#1", F.col("same").isNotNull(), F.col("any").isNull(), F.col("name").isNotNull(), F.col("overlapping"))
    return flagged.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("miss_types", f"{UNMATCHED} SELECT CASE WHEN EXISTS (FROM p WHERE p.id = g.id AND p.category = g.category) THEN 'other attribute or sentiment' ELSE 'missed' END AS kind, count(*) AS n FROM g WHERE NOT EXISTS (FROM p WHERE g.id = p.id AND g.category = p.category AND g.sentiment = p.sentiment AND g.k = p.k) GROUP BY 1")
def miss_types(spark, d):
    gold, predicted = sides(spark, d)
    _, missed = E.unmatched(gold, predicted, "id", ["category", "sentiment"])
    named = missed.join(predicted.select("id", "category").distinct().withColumn("hit", F.lit(True)), ["id", "category"], "left")
    return named.groupBy(F.when(F.col("hit").isNotNull(), "other attribute or sentiment").otherwise("missed").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("conflicting_sentiments", "SELECT l_orderkey, p_type, count(DISTINCT l_returnflag) AS sentiments FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1")
def conflicting_sentiments(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey", "p_type").agg(F.countDistinct("l_returnflag").alias("sentiments")).where("sentiments > 1")


@query("judge_summary", "WITH j AS (SELECT event_type AS model, value > 50 AS passed, value AS score FROM events WHERE event_type <> 'click' AND event_id % 7 <> 0), m AS (SELECT DISTINCT event_type AS model FROM events) SELECT model, count(score) AS items, coalesce(round_even(avg(passed::INT), 4), 0) AS pass_rate, coalesce(round_even(avg(score), 2), 0) AS mean_score FROM m LEFT JOIN j USING (model) GROUP BY 1")
def judge_summary(spark, d):
    e = table(spark, d, "events")
    judged = e.where("event_type <> 'click'").selectExpr("event_type AS model", "value > 50 AS passed", "CASE WHEN event_id % 7 <> 0 THEN value END AS score")
    return E.judge_summary(e.select(F.col("event_type").alias("model")).distinct(), judged).withColumn("mean_score", F.bround("mean_score", 2))


@query("pair_combinations", "WITH o AS (SELECT DISTINCT user_id, event_type FROM events) SELECT a.user_id, a.event_type AS left_model, b.event_type AS right_model FROM o a JOIN o b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def pair_combinations(spark, d):
    o = table(spark, d, "events").select("user_id", F.col("event_type").alias("model")).distinct().withColumn("ordinal", F.col("model"))
    return E.model_pairs(o, "user_id", "ordinal")


@query("cross_minus_done", "SELECT u.user_id, m.event_type AS model FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) m WHERE NOT EXISTS (FROM events e WHERE e.user_id = u.user_id AND e.event_type = m.event_type AND e.value > 50)")
def cross_minus_done(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("model"), "value")
    return E.cross_minus_done(e.select("user_id").distinct(), e.select("model").distinct(), e.where("value > 50").distinct(), ["user_id", "model"])


@query(
    "latency_stats",
    """WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) > 3), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM k)
      SELECT event_type, count(*) AS requests, round_even(sum(value::DECIMAL(20,6))::DOUBLE / count(*), 4) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (i = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(value) FILTER (i = round_even((n - 1) * 0.95::DOUBLE, 0)) AS p95 FROM r GROUP BY 1""",
)
def latency_stats(spark, d):
    return E.latency_stats(table(spark, d, "events").withColumnRenamed("value", "latency"), ["event_type"], ["ts", "event_id"], 3)


@query("gap_audit", "WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT user_id, count(*) AS gaps, round_even(median(gap), 3) AS median_gap, count(*) FILTER (gap > 36000) AS slow FROM g WHERE gap IS NOT NULL GROUP BY 1")
def gap_audit(spark, d):
    return E.gap_audit(table(spark, d, "events"), ["user_id"], "ts", ["event_id"], 36000)


@query("metrics_pivot", "SELECT event_type AS metric, (sum(value) FILTER (u = 0))::BIGINT AS m0, (sum(value) FILTER (u = 1))::BIGINT AS m1, (sum(value) FILTER (u = 2))::BIGINT AS m2 FROM (SELECT event_type, user_id % 3 AS u, count(*) AS value FROM events GROUP BY ALL) GROUP BY 1")
def metrics_pivot(spark, d):
    long = table(spark, d, "events").groupBy(F.col("event_type").alias("metric"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model")).agg(F.count(F.lit(1)).alias("value"))
    return E.metrics_pivot(long, ["m0", "m1", "m2"])


@query("category_split_pivot", "SELECT lang, count(*) FILTER (source = 'src0') AS hot, count(*) FILTER (source <> 'src0') AS rest, count(DISTINCT source) AS places, max(n) AS most FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) GROUP BY 1")
def category_split_pivot(spark, d):
    by = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("lang").agg(F.sum(F.when(F.col("source") == "src0", F.col("n")).otherwise(0)).alias("hot"), F.sum(F.when(F.col("source") != "src0", F.col("n")).otherwise(0)).alias("rest"), F.count(F.lit(1)).alias("places"), F.max("n").alias("most"))


@query("top_frequencies", "SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 12")
def top_frequencies(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(12)


@query("resume_anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey)")
def resume_anti_join(spark, d):
    return pending(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), key="o_orderkey")


@query("latest_decision", "SELECT user_id, CASE event_type WHEN 'purchase' THEN 'gold' WHEN 'click' THEN 'discarded' ELSE 'pending' END AS state, value > 50 AS edited FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_decision(spark, d):
    e = table(spark, d, "events").withColumn("state", F.when(F.col("event_type") == "purchase", "gold").when(F.col("event_type") == "click", "discarded").otherwise("pending"))
    return logs.latest_state(e, "user_id", ["ts", "event_id"]).select("user_id", "state", (F.col("value") > 50).alias("edited"))


@query("failure_runs", "WITH n AS (SELECT user_id, event_id, ts, value < 30 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 30 ORDER BY ts, event_id) AS island FROM events), r AS (SELECT user_id, island, count(*) AS run FROM n WHERE failed GROUP BY ALL) SELECT user_id, max(run) AS longest FROM r GROUP BY 1")
def failure_runs(spark, d):
    return logs.longest_failure_run(table(spark, d, "events").withColumn("failed", F.col("value") < 30), ["user_id"], ["ts", "event_id"])


@query("benchmark_in_source", "SELECT item_id, count(*) FILTER (contains(d.text, b.text)) AS documents FROM benchmark b, documents d GROUP BY 1")
def benchmark_in_source(spark, d):
    """How many documents hold an item's text word for word."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    found = curation.texts_holding(table(spark, d, "documents").select("doc_id", "text"), items, "item_id", "item")
    counts = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id").join(counts, "item_id", "left").na.fill(0, ["documents"])
