"""Writers (SNK1-SNK6, SNK10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line; the job's commit makes the replacement atomic."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_category(df: DataFrame, path: str, category: str = "category", order: str = "place_id") -> None:
    """A folder per category, rows in order within a file."""
    df.sortWithinPartitions(category, order).write.mode("overwrite").partitionBy(category).json(path)


def grouped_by_place(places: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every place with its reviews in order of id, and their number; places without any have an empty list."""
    fields = [c for c in reviews.columns if c != "place_id"]
    lists = reviews.groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct("review_id", *[c for c in fields if c != "review_id"]))).alias("reviews"))
    kind = lists.schema["reviews"].dataType.simpleString()
    return places.join(lists, "place_id", "left").withColumn("reviews", F.coalesce("reviews", F.array().cast(kind))).withColumn("review_count", F.size("reviews").cast("long"))


def manifest(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by the values of each dimension: dimension, value, rows."""
    one = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dims]
    return df.select(F.explode(F.array(*one)).alias("e")).groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("rows"))


def fixed_lines(df: DataFrame, column: str, fixed: str) -> DataFrame:
    """How many rows a fix changes, and how many broken tokens remain."""
    tokens = F.size(F.regexp_extract_all(F.col(fixed), F.lit("(<0x[0-9A-F]{2}>)"), F.lit(1)))
    return df.agg(F.count_if(~F.col(column).eqNullSafe(F.col(fixed))).alias("changed"), F.coalesce(F.sum(tokens), F.lit(0)).alias("left_over"))


def rewrite_fixed(df: DataFrame, column: str, fixed: str, backup: str, path: str) -> DataFrame:
    """Keep the rows as they were under backup, write them with the fix under path, and return the counts of fixed_lines.

    Where nothing changes nothing is written.
    """
    counts = fixed_lines(df, column, fixed)
    if counts.first().changed:
        write_jsonl(df.drop(fixed), backup)
        write_jsonl(df.withColumn(column, F.col(fixed)).drop(fixed), path)
    return counts
