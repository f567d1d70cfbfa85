"""Queries of text cleaning, keys, label rules and validation. Latin words stand for the Korean ones in driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.functions import requirements
from cairn.operators import labels
from cairn.plans.registry import query
from cairn.session import table

WS = "[\\s\\p{Z}]"


@query("html_clean", r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') AS text FROM pages")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", X.clean(F.col("html")).alias("text"))


@query("dedup_key", r"SELECT doc_id, lang AS category, lower(regexp_replace(text, '[\s()\[\]·,.\-]', '', 'g')) AS name_key, lower(regexp_replace(regexp_replace(text, '[,(](.|\n)*$', ''), '[\s()\[\]·,.\-]', '', 'g')) AS head_key FROM documents")
def dedup_key(spark, d):
    """Key of a place: category, normalised name, normalised head of the address."""
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), X.normalize_name(F.col("text")).alias("name_key"), X.normalize_name(X.address_head(F.col("text"))).alias("head_key"))


ADDRESS = "CASE WHEN c_custkey % 5 = 0 THEN '부산광역시 수영구 광안동' ELSE '부산광역시 해운대구 센텀' || (c_custkey % 40) || '로 ' || (c_custkey % 7) || '번길 ' || (c_custkey % 90 + 1) || ' (우동, 옆)' END"
DISTRICT = "CASE c_nationkey % 4 WHEN 0 THEN '부산 수영구 어딘가' WHEN 1 THEN '해운대구청 앞' WHEN 2 THEN '광안리 해변' ELSE 'elsewhere' END"


@query(
    "road_name_keys",
    rf"SELECT c_custkey, nullif(concat_ws(' ', nullif(regexp_extract(a, '([가-힣0-9]+(?:로|길))\s+(\d+(?:-\d+)?)', 1), ''), nullif(regexp_extract(a, '([가-힣0-9]+(?:로|길))\s+(\d+(?:-\d+)?)', 2), '')), '') AS road, lower(regexp_replace(c_name || ' (x,y) Z', '\(.*?\)|\s', '', 'g')) AS name FROM (SELECT *, regexp_replace(regexp_replace({ADDRESS}, '[,(].*$', ''), '\s+(\d+번길)', '\1', 'g') AS a FROM customer)",
)
def road_name_keys(spark, d):
    return table(spark, d, "customer").withColumn("address", F.expr(ADDRESS)).select("c_custkey", X.road_key(F.col("address")).alias("road"), X.name_key(F.concat("c_name", F.lit(" (x,y) Z"))).alias("name"))


@query(
    "district_chain",
    f"SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'suyeong' WHEN 1 THEN 'haeundae' WHEN 2 THEN 'suyeong' END AS district FROM customer",
)
def district_chain(spark, d):
    """Address word, else a neighbourhood within the text; null where neither is known."""
    from cairn import vocab

    by_name = {v: k for k, v in vocab.DISTRICT_NAMES.items()}
    text = F.expr(DISTRICT)
    return table(spark, d, "customer").select("c_custkey", F.coalesce(X.first_word_in(text, by_name), X.first_part_of(text, vocab.NEIGHBORHOODS)).alias("district"))


@query("category_synonyms", "SELECT c_custkey, CASE lower(trim(' ' || c_mktsegment || ' ')) WHEN 'building' THEN 'hotel' WHEN 'household' THEN 'hotel' WHEN 'machinery' THEN 'attraction' END AS category, split_part(c_name, '#', 1) AS head, CASE WHEN c_name LIKE 'Customer%' THEN 'restaurant' END AS by_prefix FROM customer")
def category_synonyms(spark, d):
    words = {"building": "hotel", "household": "hotel", "machinery": "attraction"}
    c = table(spark, d, "customer")
    return c.select("c_custkey", X.map_lookup(words, F.lower(X.py_strip(F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))))).alias("category"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("head"), X.first_match([(F.col("c_name").startswith("Customer"), "restaurant"), (F.col("c_name").startswith("Hotel"), "hotel")]).alias("by_prefix"))


@query("alias_coalesce", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.key') AS VARCHAR), nullif(event_type, ''), 'none') AS value, CASE WHEN json_extract_string(props, '$.key') IS NOT NULL THEN 'key' ELSE 'event_type' END AS alias FROM events")
def alias_coalesce(spark, d):
    """The first alias of a field that has a value, and which one it was."""
    e = table(spark, d, "events").withColumn("v", F.expr("try_variant_get(try_parse_json(props), '$.key', 'string')"))
    return e.select("event_id", F.coalesce("v", F.nullif("event_type", F.lit("")), F.lit("none")).alias("value"), F.when(F.col("v").isNotNull(), "key").otherwise("event_type").alias("alias"))


@query("facts_map", "SELECT p_partkey, concat_ws(';', 'brand=' || nullif(trim(p_brand), ''), 'size=' || CAST(nullif(p_size, 5) AS VARCHAR), 'type=' || nullif(p_type, 'STANDARD')) AS facts FROM part")
def facts_map(spark, d):
    """Named facts without the empty ones."""
    p = table(spark, d, "part").withColumn("m", X.keyed_map([("brand", F.col("p_brand")), ("size", F.expr("CAST(nullif(p_size, 5) AS STRING)")), ("type", F.expr("nullif(p_type, 'STANDARD')"))]))
    return p.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";").alias("facts"))


@query("evidence_normalize", r"WITH e AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN '솔직히 ' WHEN 1 THEN '전체적으로는 , ' ELSE '' END || split_part(text, '.', 1) || CASE doc_id % 2 WHEN 0 THEN ' .!~' ELSE '…  ' END AS evidence FROM documents), n AS (SELECT *, regexp_replace(regexp_replace(trim(evidence, E' \n\t'), '^(?:전반적으로는|전체적으로는|전반적으로|전체적으로|솔직히|그래도) [ ,]*', ''), '(?:\s*[.!?,~…]+)?\s*$', '') AS short FROM e) SELECT doc_id, CASE WHEN length(short) < 3 OR NOT contains(text, short) THEN evidence ELSE short END AS evidence FROM n")
def evidence_normalize(spark, d):
    lead = F.when(F.col("doc_id") % 3 == 0, "솔직히 ").when(F.col("doc_id") % 3 == 1, "전체적으로는 , ").otherwise("")
    tail = F.when(F.col("doc_id") % 2 == 0, " .!~").otherwise("…  ")
    e = table(spark, d, "documents").withColumn("evidence", F.concat(lead, F.split_part("text", F.lit("."), F.lit(1)), tail))
    return e.select("doc_id", labels.normalize_evidence(F.col("evidence"), F.col("text")).alias("evidence"))


@query("trailing_punct_metric", r"SELECT doc_id, regexp_replace(trim(text, E' \n\t'), '[.,!?~…·]*\s*$', '') AS evidence FROM documents")
def trailing_punct_metric(spark, d):
    return table(spark, d, "documents").select("doc_id", labels.metric_evidence(F.col("text")).alias("evidence"))


@query("topic_check", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name LIKE '%주차%' WHEN 1 THEN NOT (p_brand = 'Brand#11') ELSE true END AS on_topic FROM part")
def topic_check(spark, d):
    """Aspects with a rule need a word of their topic, others pass."""
    aspect = F.expr("CASE p_size % 3 WHEN 0 THEN 'parking_availability' WHEN 1 THEN 'toilet_facilities' ELSE 'scenery' END")
    evidence = F.when((F.col("p_size") % 3 == 1) & (F.col("p_brand") != "Brand#11"), F.concat("p_name", F.lit(" 화장실"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", labels.mentions_topic(aspect, evidence).alias("on_topic"))


RELABEL = "CASE p_size % 4 WHEN 0 THEN '방이 깨끗' WHEN 1 THEN '시설이 낡' WHEN 2 THEN '깨끗하지만 오래된' ELSE '얼룩이 있음' END"


@query(
    "relabel_pairs",
    f"""SELECT p_partkey, CASE WHEN c = 'room_condition' AND clean AND NOT worn THEN 'cleanliness' WHEN c = 'cleanliness' AND worn AND NOT clean THEN 'room_condition' ELSE c END AS category,
      CASE WHEN c = 'room_condition' AND clean AND NOT worn THEN CASE WHEN dirty THEN 'dirty' ELSE 'clean' END WHEN c = 'cleanliness' AND worn AND NOT clean THEN 'well_kept' ELSE a END AS attribute
      FROM (SELECT *, regexp_matches(e, '깨끗|얼룩') AS clean, regexp_matches(e, '낡|오래된') AS worn, regexp_matches(e, '얼룩') AS dirty, CASE WHEN p_partkey % 2 = 0 THEN 'room_condition' ELSE 'cleanliness' END AS c, CASE WHEN p_partkey % 2 = 0 THEN 'well_kept' ELSE 'clean' END AS a FROM (SELECT *, {RELABEL} AS e FROM part))""",
)
def relabel_pairs(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", f"{RELABEL} AS e", "CASE WHEN p_partkey % 2 = 0 THEN 'room_condition' ELSE 'cleanliness' END AS c", "CASE WHEN p_partkey % 2 = 0 THEN 'well_kept' ELSE 'clean' END AS a")
    category, attribute = labels.unify_aspect(F.col("c"), F.col("a"), F.col("e"))
    return p.select("p_partkey", category.alias("category"), attribute.alias("attribute"))


WISH = "CASE c_custkey % 5 WHEN 0 THEN '부모님과 바다, 계단 싫어요' WHEN 1 THEN '아이랑 조용한 식당 웨이팅 없는 곳' WHEN 2 THEN '친구랑 사진 맛집' WHEN 3 THEN '걷기 힘들어서 쉬고 싶은 호텔' ELSE c_name END"


@query(
    "keyword_conditions",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'parents' WHEN 1 THEN 'kids' WHEN 2 THEN 'friends' END AS companion, CASE WHEN c_custkey % 5 = 3 THEN 'low' END AS walk,
      CASE c_custkey % 5 WHEN 0 THEN 'sea' WHEN 1 THEN 'quiet' WHEN 2 THEN 'food,photo' WHEN 3 THEN 'rest' ELSE '' END AS pri, CASE c_custkey % 5 WHEN 0 THEN 'stairs' WHEN 1 THEN 'waiting' ELSE '' END AS avoid,
      CASE c_custkey % 5 WHEN 1 THEN 'restaurant' WHEN 2 THEN 'restaurant' WHEN 3 THEN 'hotel' END AS category FROM customer""",
)
def keyword_conditions(spark, d):
    c = table(spark, d, "customer").select("c_custkey", requirements.conditions(F.expr(WISH)).alias("q"))
    return c.select("c_custkey", F.col("q.with").alias("companion"), "q.walk", F.array_join("q.pri", ",").alias("pri"), F.array_join("q.avoid", ",").alias("avoid"), "q.category")


@query("csv_param_distinct", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'sea,quiet' WHEN 1 THEN 'food' ELSE 'rest,x' END AS parsed, CASE c_custkey % 3 WHEN 2 THEN 'x' ELSE '' END AS unknown FROM customer")
def csv_param_distinct(spark, d):
    text = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'sea, quiet,sea' WHEN 1 THEN ' food ,,' ELSE 'rest,x,rest' END")
    values, unknown = requirements.csv_values(text, ["sea", "food", "photo", "rest", "quiet", "culture"])
    return table(spark, d, "customer").select("c_custkey", F.array_join(values, ",").alias("parsed"), F.array_join(unknown, ",").alias("unknown"))


@query(
    "label_check_reasons",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, p_type AS kind, p_brand AS category, p_size AS attribute, l_returnflag AS sentiment, CASE WHEN l_tax > 0.07 THEN ' ' ELSE substr(p_name, 1, 4) END AS evidence, CASE WHEN l_discount > 0.08 THEN 'other' ELSE p_name END AS review FROM lineitem JOIN part ON l_partkey = p_partkey),
      v AS (SELECT DISTINCT p_type AS kind, p_brand AS category, p_size AS attribute FROM part WHERE p_retailprice < 1500)
      SELECT CASE WHEN NOT EXISTS (FROM v WHERE v.kind = a.kind AND v.category = a.category) THEN 'aspect' WHEN NOT EXISTS (FROM v WHERE v.kind = a.kind AND v.category = a.category AND v.attribute = a.attribute) THEN 'attribute'
        WHEN sentiment = 'N' THEN 'sentiment' WHEN trim(evidence) = '' THEN 'no evidence' WHEN NOT contains(review, evidence) THEN 'evidence not in review' END AS problem, count(*) AS n FROM a GROUP BY 1""",
)
def label_check_reasons(spark, d):
    """How many labels break which rule first."""
    part = table(spark, d, "part")
    v = part.where("p_retailprice < 1500").select(F.col("p_type").alias("category"), F.col("p_brand").alias("aspect"), F.col("p_size").alias("attribute"))
    a = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "p_type AS kind", "p_brand AS category", "p_size AS attribute", "CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'A' THEN 'negative' ELSE 'odd' END AS sentiment", "CASE WHEN l_tax > 0.07 THEN ' ' ELSE substr(p_name, 1, 4) END AS evidence", "CASE WHEN l_discount > 0.08 THEN 'other' ELSE p_name END AS review",
    )
    return labels.aspect_problem(a, v).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "record_check",
    "SELECT conv_id, turn, concat_ws(';', CASE WHEN conv_id % 7 = 0 THEN 'place_id missing' END, CASE WHEN trim(text, E' \\n\\t') = '' THEN 'review blank' END, CASE WHEN role NOT IN ('user') THEN 'category unknown' END, CASE WHEN conv_id % 11 = 0 THEN 'broken bytes' END, CASE WHEN turn = 2 THEN 'synthetic missing' END) AS problems FROM conversations",
)
def record_check(spark, d):
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", "conv_id AS review_id", "nullif(conv_id % 7, 0) AS place_id", "CASE WHEN conv_id % 11 = 0 THEN text || '<0xE2>' ELSE text END AS review", "CASE role WHEN 'user' THEN 'hotel' ELSE role END AS category", "CASE WHEN turn <> 2 THEN true END AS synthetic")
    return labels.check_records(c).select("conv_id", "turn", F.array_join("problems", ";").alias("problems"))


@query(
    "constraint_violations",
    """SELECT 'unique' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'foreign key', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
      UNION ALL SELECT 'check', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.08)""",
)
def constraint_violations(spark, d):
    """Rows that break a unique key, a foreign key or a check."""
    li = table(spark, d, "lineitem")
    unique = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.lit("unique").alias("rule"), F.count(F.lit(1)).alias("n"))
    parents = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    foreign = li.join(parents, "l_orderkey", "left_anti").agg(F.lit("foreign key").alias("rule"), F.count(F.lit(1)).alias("n"))
    check = li.where("NOT (l_discount BETWEEN 0 AND 0.08)").agg(F.lit("check").alias("rule"), F.count(F.lit(1)).alias("n"))
    return unique.union(foreign).union(check)


@query("place_rule_labels", "SELECT p_partkey, concat_ws(';', CASE WHEN p_size % 3 = 0 THEN 'parking_availability=' || CASE WHEN p_size % 2 = 0 THEN 'unavailable' ELSE 'available' END END, CASE p_size % 4 WHEN 0 THEN 'weather_sensitivity=high' WHEN 1 THEN 'weather_sensitivity=low' END, CASE p_size % 4 WHEN 0 THEN 'stay_duration=short' WHEN 1 THEN 'stay_duration=medium' END) AS made FROM part")
def place_rule_labels(spark, d):
    """Labels that follow from facts of a place where the review has none."""
    p = table(spark, d, "part").selectExpr("p_partkey", "'attraction' AS category", "CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN '주차 불가, 가능' ELSE '주차 가능' END END AS parking", "CASE p_size % 4 WHEN 0 THEN 'HS010100' WHEN 1 THEN 'VE070200' ELSE 'ZZ' END AS class_code", f"CAST(array() AS array<struct<category:string,attribute:string,sentiment:string,evidence:string>>) AS aspects")
    return labels.with_place_aspects(p).select("p_partkey", F.array_join(F.transform("aspects", lambda a: F.concat(a.category, F.lit("="), a.attribute)), ";").alias("made"))


SALVAGE = """WITH p AS (SELECT conv_id, turn, text, '{"traveler_context": ["solo"], "aspects": [' AS head, '{"category":"scenery","evidence":' || to_json(text) || '}' AS a, '{"category":"portion","evidence":"}{]","more":{"n":[' || turn || ',{"k":"[2"}]}}' AS b FROM conversations),
  w AS (SELECT *, head || a || ', 3, ' || b || ']}' AS whole, length(head) AS h, length(head) + length(a) AS ea, length(head) + length(a) + 5 + length(b) AS eb FROM p),
  c AS (SELECT *, 1 + (conv_id * 7919 + turn * 104729) % length(whole) AS cut FROM w)
  SELECT conv_id, turn, turn % 3 = 0 OR (turn % 3 = 1 AND cut = length(whole)) AS json_valid, turn % 3 = 1 AND cut >= h AND cut < length(whole) AS salvaged,
    CASE WHEN turn % 3 = 0 OR (turn % 3 = 1 AND cut = length(whole)) THEN whole WHEN turn % 3 = 1 AND cut >= h THEN head || CASE WHEN cut >= eb THEN a || ', ' || b WHEN cut >= ea THEN a ELSE '' END || ']}' END AS label_json FROM c"""


@query("json_salvage", SALVAGE)
def json_salvage(spark, d):
    """Labels from model outputs that are whole, cut off anywhere or no JSON at all."""
    quoted = F.regexp_replace(F.to_json(F.array("text")), r"(?s)^\[|\]$", "")
    whole = F.concat(F.lit('{"traveler_context": ["solo"], "aspects": [{"category":"scenery","evidence":'), quoted, F.lit('}, 3, {"category":"portion","evidence":"}{]","more":{"n":['), F.col("turn").cast("string"), F.lit(',{"k":"[2"}]}}]}'))
    cut = F.substring(whole, F.lit(1), (F.lit(1) + F.pmod(F.col("conv_id") * 7919 + F.col("turn") * 104729, F.length(whole))).cast("int"))
    c = table(spark, d, "conversations").withColumn("raw_output", F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), whole, F.lit("\n"))).when(F.col("turn") % 3 == 1, cut).otherwise(F.col("text")))
    return labels.with_salvaged(c).select("conv_id", "turn", "json_valid", "salvaged", "label_json")


@query("byte_token_decode", "SELECT doc_id, replace(replace(text, 'th', '가'), 'en', '<0xFF>') AS text FROM documents")
def byte_token_decode(spark, d):
    coded = table(spark, d, "documents").withColumn("text", F.replace(F.replace("text", F.lit("th"), F.lit("<0xEA><0xB0><0x80>")), F.lit("en"), F.lit("<0xFF>")))
    # a run that spells no character stays as it is: the two kinds must not touch
    return labels.with_decoded_bytes(coded.withColumn("text", F.replace(F.replace("text", F.lit("><0xFF>"), F.lit(">\u0001<0xFF>")), F.lit("<0xFF><0xEA>"), F.lit("<0xFF>\u0001<0xEA>"))), "text", "decoded").select("doc_id", F.replace("decoded", F.lit("\u0001"), F.lit("")).alias("text"))
