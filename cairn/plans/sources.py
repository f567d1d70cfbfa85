"""Queries that read and write through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.exprs import clean
from cairn.plans.registry import query
from cairn.session import scratch, table
from cairn.sources import files, rest, sinks
from cairn.streaming import logs


@query("jsonl_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark, d):
    path = scratch(spark, "jsonl")
    docs = table(spark, d, "documents")
    sinks.write_jsonl(docs, path)
    return files.read_jsonl(spark, path, docs.schema)


@query("category_partitions", "SELECT c_custkey AS place_id, c_mktsegment AS category FROM customer")
def category_partitions(spark, d):
    path = scratch(spark, "places")
    sinks.write_by_category(table(spark, d, "customer").selectExpr("c_custkey AS place_id", "c_mktsegment AS category"), path)
    return spark.read.schema("place_id long, category string").json(path)


@query("reviews_by_place", "SELECT p_partkey AS place_id, count(l_orderkey) AS review_count, coalesce(string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey), '') AS reviews FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def reviews_by_place(spark, d):
    reviews = table(spark, d, "lineitem").selectExpr("l_partkey AS place_id", "l_orderkey AS review_id")
    g = sinks.grouped_by_place(table(spark, d, "part").selectExpr("p_partkey AS place_id"), reviews)
    return g.select("place_id", "review_count", F.array_join(F.transform("reviews", lambda r: r.review_id.cast("string")), ",").alias("reviews"))


@query("manifest_counts", "SELECT 'lang' AS dimension, lang AS value, count(*) AS rows FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def manifest_counts(spark, d):
    return sinks.manifest(table(spark, d, "documents"), ["lang", "source"])


@query("records_discovery", "SELECT event_id, CAST(CASE event_id % 4 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS records FROM events")
def records_discovery(spark, d):
    """Records in arrays, in arrays within objects, and single objects."""
    js = F.expr("CASE event_id % 4 WHEN 0 THEN concat('[3, ', props, ', [1]]') WHEN 1 THEN concat('{\"a\": 1, \"items\": [', props, ', ', props, ']}') WHEN 3 THEN concat('{\"none\": [3, ', props, '], \"items\": [', props, ', 3, ', props, ']}') ELSE props END")
    e = table(spark, d, "events").select("event_id", F.concat(F.lit(" "), js).alias("js"))
    return files.records_in(e, "js").groupBy("event_id").agg(F.count(F.lit(1)).alias("records"))


@query("dry_run_calls", "SELECT c.seg, n.n_name FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) c CROSS JOIN nation n WHERE NOT EXISTS (FROM customer x WHERE x.c_mktsegment = c.seg AND x.c_nationkey = n.n_nationkey AND x.c_acctbal > 9000)")
def dry_run_calls(spark, d):
    """Which (category, district) lookups the cache does not hold."""
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    cached = c.where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("seg"), "n_name")
    return rest.planned_calls(c.select(F.col("c_mktsegment").alias("seg")).distinct(), n.select("n_name"), cached, ["seg", "n_name"])


@query("stream_resume", "SELECT event_id, user_id, event_type FROM events")
def stream_resume(spark, d):
    """A stream over the events, run twice into the same sink: every id arrives once."""
    sink = scratch(spark, "sink")
    for run in range(2):
        source = spark.readStream.schema(table(spark, d, "events").schema).format("parquet").load(f"{d}/events.parquet*")
        logs.run_available(source, sink, scratch(spark, f"cp{run}"), "event_id", lambda df: df.select("event_id", "user_id", "event_type"))
    return spark.read.parquet(sink)


@query("phone_clean", r"SELECT c_custkey, nullif(replace(trim(regexp_replace(regexp_replace('<b> ' || c_name || '</b> 051 ' || c_custkey, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), ' ', ''), '') AS phone FROM customer")
def phone_clean(spark, d):
    from cairn.functions.exprs import clean_phone

    return table(spark, d, "customer").select("c_custkey", clean_phone(F.concat(F.lit("<b> "), "c_name", F.lit("</b> 051 "), F.col("c_custkey").cast("string"))).alias("phone"))
