"""Queries of deduplication, sampling, splits, caps and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import vocab
from cairn.operators import curation as C
from cairn.operators import labels
from cairn.plans.registry import query
from cairn.session import table

HASH = "sha256('{seed}:' || CAST({id} AS VARCHAR))"


def docs(spark, d):
    return table(spark, d, "documents")


@query("first_wins_distinct", "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, trim(text, E' \\n\\t') ORDER BY doc_id) = 1")
def first_wins_distinct(spark, d):
    from cairn.functions.exprs import py_strip

    return C.first_wins(docs(spark, d).withColumn("k", py_strip(F.col("text"))), ["source", "k"], ["doc_id"]).select("doc_id", "lang", "source")


@query("last_wins_distinct", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_wins_distinct(spark, d):
    return C.last_wins(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("split_overlay", "SELECT coalesce(n.user_id, o.o_custkey) AS id, coalesce(n.e, o.p) AS split FROM (SELECT user_id, max(event_type) AS e FROM events GROUP BY 1) n FULL JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) o ON n.user_id = o.o_custkey")
def split_overlay(spark, d):
    new = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_type").alias("split"))
    old = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("split"))
    return C.overlay(new, old, "id", "split")


@query("pending_except", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def pending_except(spark, d):
    gold = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    gone = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("o_orderkey"))
    return C.pending(table(spark, d, "orders").select("o_orderkey"), gold, gone, key="o_orderkey")


@query("intersect_ids", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def intersect_ids(spark, d):
    return C.in_all(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", 3)


@query("hash_cap_per_place", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {HASH.format(seed='42', id='doc_id')}, doc_id) <= 15")
def hash_cap_per_place(spark, d):
    return C.cap_by_hash(docs(spark, d), ["source"], "doc_id", 15, "42").select("doc_id", "source")


@query("hash_nested_sample", f"SELECT doc_id, lang FROM documents ORDER BY {HASH.format(seed='7', id='doc_id')}, doc_id LIMIT 100")
def hash_nested_sample(spark, d):
    return C.nested_sample(docs(spark, d), "doc_id", 100, "7").select("doc_id", "lang")


RANKED = "SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (PARTITION BY {s} ORDER BY {h}, c_custkey) AS i, count(*) OVER (PARTITION BY {s}) AS n FROM customer"


@query("stratified_split", f"SELECT c_custkey, CASE WHEN i <= t THEN 'test' WHEN i <= t + t THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CAST(round_even(n * 0.1::DOUBLE, 0) AS INT) AS t FROM ({RANKED.format(s='c_mktsegment, c_nationkey', h=HASH.format(seed='s', id='c_custkey'))}))")
def stratified_split(spark, d):
    return C.stratified_split(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", "s").select("c_custkey", "split")


@query("small_n_split", f"SELECT c_custkey, CASE WHEN n >= 3 AND i - 1 < greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'test' WHEN n >= 3 AND i - 1 < greatest(2, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' WHEN n = 2 AND i = 1 THEN 'test' ELSE 'train' END AS split FROM ({RANKED.format(s='c_nationkey, c_custkey // 40', h=HASH.format(seed='n', id='c_custkey'))})")
def small_n_split(spark, d):
    c = table(spark, d, "customer").withColumn("g", F.expr("c_custkey div 40"))
    return C.small_n_split(c, ["c_nationkey", "g"], "c_custkey", "n").select("c_custkey", "split")


@query("interleave_round_robin", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS turn FROM documents")
def interleave_round_robin(spark, d):
    order = F.array_position(F.array(*map(F.lit, ["en", "de", "fr", "es"])), F.col("lang"))
    return C.interleaved(docs(spark, d), "lang", "n_chars", "doc_id", order).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


def _quota_sql(quotas: dict, budget: int, share: float) -> str:
    """One step a category, each with what the ones before it left of the budget."""
    steps, left = [], str(budget)
    for i, (lang, quota) in enumerate(quotas.items()):
        steps.append(f"may{i} AS (SELECT *, row_number() OVER (PARTITION BY empty ORDER BY k, id) AS e FROM r WHERE lang = '{lang}' AND (NOT long OR nth <= {left}))")
        steps.append(f"pick{i} AS (SELECT * FROM may{i} WHERE NOT empty OR e <= {round(quota * share)} QUALIFY row_number() OVER (ORDER BY k, id) <= {quota})")
        left += f" - (SELECT count(*) FROM pick{i} WHERE long)"
    rows = "r AS (SELECT doc_id AS id, lang, coalesce(length(text) < 200, false) AS empty, coalesce(length(text) > 400, false) AS long, sha256('q:' || doc_id) AS k, row_number() OVER (PARTITION BY lang, coalesce(length(text) > 400, false) ORDER BY sha256('q:' || doc_id), doc_id) AS nth FROM documents)"
    return f"WITH {rows}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT id AS review_id, lang AS category FROM pick{i}" for i in range(len(quotas)))


QUOTAS = {"en": 60, "de": 40, "fr": 40}


@query("quota_pick", _quota_sql(QUOTAS, 50, 0.2))
def quota_pick(spark, d):
    """Quotas by language under one budget of long documents, spent in the order of languages."""
    r = docs(spark, d).select(F.col("doc_id").alias("review_id"), F.col("lang").alias("category"), F.col("text").alias("review"), (F.length("text") < 200).alias("is_empty"))
    return C.quota_pick(r, QUOTAS, 50, 0.2, "q").select("review_id", "category")


CUE = "CASE WHEN regexp_matches(text, 'anon|clown') THEN 'not_positive' WHEN regexp_matches(text, 'the ') AND regexp_matches(text, 'ing') THEN 'rich' ELSE 'plain' END"


@query("drop_reasons", "WITH f AS (SELECT doc_id, text, CASE WHEN lang = 'es' THEN 'category' WHEN length(text) < 10 OR NOT regexp_matches(text, '[가-힣a-z]') THEN 'short' WHEN count(*) OVER (PARTITION BY text) >= 3 THEN 'template' END AS r FROM documents) SELECT doc_id, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY text, r IS NULL ORDER BY doc_id) > 1 THEN 'duplicate' END) AS reason FROM f")
def drop_reasons(spark, d):
    r = docs(spark, d).select(F.col("doc_id").alias("pos"), F.col("text").alias("review"), F.expr("nullif(lang, 'es')").alias("category"))
    return C.drop_reasons(r).select(F.col("pos").alias("doc_id"), "reason")


def bucketed(spark, d):
    text = F.col("text")
    return docs(spark, d).withColumn("bucket", F.when(text.rlike("anon|clown"), "not_positive").when(text.rlike("the ") & text.rlike("ing"), "rich").otherwise("plain"))


@query("cue_buckets", f"SELECT {CUE} AS bucket, lang, count(*) AS n FROM documents GROUP BY ALL")
def cue_buckets(spark, d):
    return bucketed(spark, d).groupBy("bucket", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("place_cap_by_bucket", f"SELECT doc_id, bucket FROM (SELECT *, {CUE} AS bucket FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY list_position(['not_positive', 'rich', 'plain'], bucket), {HASH.format(seed='b', id='doc_id')}, doc_id) <= 12")
def place_cap_by_bucket(spark, d):
    return C.cap_by_bucket(bucketed(spark, d), ["source"], "bucket", vocab.BUCKETS, "doc_id", 12, "b").select("doc_id", "bucket")


SHARE = """WITH b AS (SELECT *, {test} AS plain FROM {source}), c AS (SELECT *, count(*) FILTER (NOT plain) OVER (PARTITION BY {group}) AS rich, row_number() OVER (PARTITION BY {group}, plain ORDER BY {hash}, doc_id) AS rn FROM b)
  SELECT doc_id, plain FROM c WHERE NOT plain OR rn <= CAST(trunc(rich * {share}::DOUBLE / (1 - {share}::DOUBLE)) AS INT)"""


@query("plain_share_cap", SHARE.format(test=f"({CUE}) = 'plain'", source="documents", group="lang", hash=HASH.format(seed="p", id="doc_id"), share=0.3))
def plain_share_cap(spark, d):
    b = bucketed(spark, d).withColumn("plain", F.col("bucket") == "plain")
    return C.cap_share(b, ["lang"], F.col("plain"), 0.3, "doc_id", "p").select("doc_id", "plain")


@query("positive_balance", SHARE.format(test="pos", source="(SELECT doc_id, quality, bool_and(toxic = 0) AS pos FROM labels GROUP BY ALL)", group="quality", hash=HASH.format(seed="v", id="doc_id"), share=0.6))
def positive_balance(spark, d):
    """Positive-only records up to a share of their category."""
    aspects = F.collect_list(F.struct(F.when(F.col("toxic") == 0, "positive").otherwise("negative").alias("sentiment")))
    r = table(spark, d, "labels").groupBy("doc_id", "quality").agg(aspects.alias("aspects")).withColumn("plain", labels.positive_only(F.col("aspects")))
    return C.cap_share(r, ["quality"], F.col("plain"), 0.6, "doc_id", "v").select("doc_id", "plain")


@query("shortest_evidence_dedup", "SELECT l_orderkey, p_type, p_brand, l_returnflag, p_name, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY l_orderkey, p_type, p_brand, l_returnflag ORDER BY length(p_name), p_partkey) = 1")
def shortest_evidence_dedup(spark, d):
    a = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS record", "p_type AS category", "p_brand AS attribute", "l_returnflag AS sentiment", "p_name AS evidence", "p_partkey AS pos")
    return C.shortest_evidence(a, "record").selectExpr("record AS l_orderkey", "category AS p_type", "attribute AS p_brand", "sentiment AS l_returnflag", "evidence AS p_name", "pos AS p_partkey")


@query(
    "merge_duplicates",
    """WITH s AS (SELECT p_brand, p_type, p_size % 3 AS s, min(p_partkey) AS f FROM part GROUP BY ALL), src AS (SELECT p_brand, p_type, string_agg(CAST(s AS VARCHAR), ',' ORDER BY f) AS sources FROM s GROUP BY ALL)
      SELECT p_brand, p_type, arg_min(p_size, p_partkey) FILTER (p_size <> 7) AS size, any_value(sources) AS sources, arg_min(p_name, p_partkey) AS name_fact FROM part JOIN src USING (p_brand, p_type) GROUP BY ALL""",
)
def merge_duplicates(spark, d):
    p = table(spark, d, "part").selectExpr("p_brand", "p_type", "p_partkey AS pos", "nullif(p_size, 7) AS size", "array(CAST(p_size % 3 AS STRING)) AS sources", "map('name', p_name) AS facts")
    m = C.merge_duplicates(p, ["p_brand", "p_type"], "pos", ["size"])
    return m.select("p_brand", "p_type", "size", F.array_join("sources", ",").alias("sources"), F.col("facts")["name"].alias("name_fact"))


PLACES = "SELECT c_custkey AS place_id, c_mktsegment AS category, CASE WHEN c_nationkey % 5 <> 0 THEN 'd' || (c_nationkey % 5) END AS district, CASE WHEN c_custkey % 3 = 0 THEN 'x ' || (c_custkey % 400) || '로 ' || (c_nationkey + 1) ELSE '' END AS address, 'n' || (c_custkey % 700) AS name FROM customer"


@query(
    "connected_groups",
    f"""WITH RECURSIVE p AS ({PLACES}), k AS (SELECT place_id, district, 'r' || address AS k FROM p WHERE address <> '' UNION ALL SELECT place_id, district, 'n' || name FROM p),
      e AS (SELECT DISTINCT a.place_id AS a, b.place_id AS b FROM k a JOIN k b ON a.k = b.k AND a.district IS NOT DISTINCT FROM b.district),
      reach AS (SELECT place_id AS a, place_id AS b FROM p UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS place_id, min(b) AS "group" FROM reach GROUP BY 1""",
)
def connected_groups(spark, d):
    p = table(spark, d, "customer").selectExpr(*[x.strip() for x in _columns(PLACES)])
    return C.connected_groups(p, C.entity_edges(p), "place_id")


def _columns(sql: str) -> list[str]:
    """The select list of a statement without commas inside its expressions."""
    return sql[len("SELECT ") : sql.index(" FROM ")].split(", ")


REACH = f"""p AS ({PLACES}), k AS (SELECT place_id, district, 'r' || address AS k FROM p WHERE address <> '' UNION ALL SELECT place_id, district, 'n' || name FROM p),
  e AS (SELECT DISTINCT a.place_id AS a, b.place_id AS b FROM k a JOIN k b ON a.k = b.k AND a.district IS NOT DISTINCT FROM b.district),
  reach AS (SELECT place_id AS a, place_id AS b FROM p UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a), g AS (SELECT a AS place_id, min(b) AS grp FROM reach GROUP BY 1)"""


@query(
    "split_places",
    f"""WITH RECURSIVE {REACH}, old AS (SELECT c_custkey AS place_id, CASE WHEN c_nationkey < 12 THEN 'train' ELSE 'test' END AS split FROM customer WHERE c_acctbal > 8000),
      votes AS (SELECT grp, split, count(*) AS n, min(place_id) AS least FROM g JOIN old USING (place_id) GROUP BY ALL), inherited AS (SELECT grp, split FROM votes QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, least) = 1),
      heads AS (SELECT DISTINCT grp, category, coalesce(district, 'unknown') AS district FROM g JOIN p ON p.place_id = grp WHERE grp NOT IN (SELECT grp FROM inherited)),
      i AS (SELECT *, row_number() OVER (PARTITION BY category, district ORDER BY sha256('g:' || grp), grp) AS i, count(*) OVER (PARTITION BY category, district) AS n FROM heads),
      decided AS (FROM inherited UNION ALL SELECT grp, CASE WHEN i <= round_even(n * 0.1::DOUBLE, 0) THEN 'test' WHEN i <= 2 * round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END FROM i)
      SELECT place_id, coalesce(old.split, d.split) AS split FROM g JOIN decided d USING (grp) FULL JOIN old USING (place_id)""",
)
def split_places(spark, d):
    """Leak-free splits: entities share one, assigned ones keep theirs."""
    p = table(spark, d, "customer").selectExpr(*[x.strip() for x in _columns(PLACES)])
    old = table(spark, d, "customer").where("c_acctbal > 8000").selectExpr("c_custkey AS place_id", "CASE WHEN c_nationkey < 12 THEN 'train' ELSE 'test' END AS split")
    return C.split_places(p, old, "g")


POINT = "SELECT {k} AS id, CAST({k} % 3 AS VARCHAR) AS category, 35 + ({k} * 7919 % 1000) / 5000.0::DOUBLE AS lat, 129 + ({k} * 104729 % 1000) / 5000.0::DOUBLE AS lng FROM {t}"


@query(
    "haversine_nn",
    f"""WITH a AS ({POINT.format(k='c_custkey', t='customer')}), b AS ({POINT.format(k='s_suppkey', t='supplier')}),
      m AS (SELECT a.id AS left_id, b.id AS right_id, 2 * 6371.0::DOUBLE * asin(sqrt(power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lng) - radians(a.lng)) / 2), 2))) AS km FROM a JOIN b ON a.category = b.category)
      SELECT left_id, right_id, round_even(km, 6) AS km FROM m WHERE km <= 1.5 QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY km, right_id) = 1""",
)
def haversine_nn(spark, d):
    point = lambda t, k: table(spark, d, t).selectExpr(f"{k} AS id", f"CAST({k} % 3 AS STRING) AS category", f"35 + ({k} * 7919 % 1000) / 5000.0D AS lat", f"129 + ({k} * 104729 % 1000) / 5000.0D AS lng")
    return C.nearest_within(point("customer", "c_custkey"), point("supplier", "s_suppkey"), 1.5).withColumn("km", F.bround("km", 6))
