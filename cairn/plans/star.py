"""The driver tables in the roles of the review data, as DataFrames and as the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import table, tasks_for

SENTIMENT = "CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END"
TIER = "CASE l_linestatus WHEN 'F' THEN 'gold' ELSE 'silver' END"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed dimensions
    return table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS place_id", "c_name AS place_name", "c_mktsegment AS category", "n_name AS district", "r_name AS region")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS review_id", "o_custkey AS place_id", "o_orderdate AS created", "o_orderstatus = 'P' AS is_synthetic", "o_orderpriority AS review_text")


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of reviews; equal rows of lineitem are one annotation each, told apart by nothing."""
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    return table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey AS review_id", "p_type AS aspect", "p_brand AS attribute", f"{SENTIMENT} AS sentiment", f"{TIER} AS tier", "p_name AS evidence_text", "l_partkey AS annotation_id", "l_linenumber AS line",
    )


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Annotations with the place of their review, dealt by review."""
    return annotations(spark, d).repartition(tasks_for(table(spark, d, "lineitem")), "review_id").join(reviews(spark, d).select("review_id", "place_id").hint("merge"), "review_id")


def companions(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("companion"))
    return table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("review_id"), "companion").repartition(tasks_for(table(spark, d, "lineitem")), "review_id").distinct()


SQL = f"""
candidates AS (SELECT c_custkey AS place_id, c_name AS place_name, c_mktsegment AS category, n_name AS district, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
reviews AS (SELECT o_orderkey AS review_id, o_custkey AS place_id, o_orderdate AS created, o_orderstatus = 'P' AS is_synthetic, o_orderpriority AS review_text FROM orders),
annotations AS (SELECT l_orderkey AS review_id, p_type AS aspect, p_brand AS attribute, {SENTIMENT} AS sentiment, {TIER} AS tier, p_name AS evidence_text, l_partkey AS annotation_id, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
annotated AS (SELECT a.*, r.place_id FROM annotations a JOIN reviews r USING (review_id)),
companions AS (SELECT DISTINCT l_orderkey AS review_id, r_name AS companion FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def sql(body: str, *more: str) -> str:
    """A statement over the views above."""
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + body


SCORES = (
    "counts AS (SELECT place_id, aspect, count(*) FILTER (sentiment = 'positive') AS pos, count(*) FILTER (sentiment = 'negative') AS neg, count(*) FILTER (sentiment = 'neutral') AS neu FROM annotated GROUP BY ALL)",
    "scored AS (SELECT *, pos + neg + neu AS mentions, round_even(50 + (100 * (pos + 0.5::DOUBLE * neu) / (pos + neg + neu) - 50) * (pos + neg + neu) / (pos + neg + neu + 2), 1) AS goodness FROM counts)",
    "totals AS (SELECT place_id, count(*) AS reviews FROM reviews GROUP BY 1)",
)
