"""Row numbers within groups that may hold most of a table, in two phases: no task gets a whole group.

A group's rows are dealt to buckets that follow its order; buckets are counted, a window over a group's few buckets gives
the rows before each, and a second window numbers the rows of one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets by value, and the error of their bounds as a share of the rows.
CUTS, CUT_ERROR = 256, 1 / 2048


def _numbered(df: DataFrame, keys: list[str], buckets: list[str], order: list, number: str, size: str | None) -> DataFrame:
    group = [F.col(k) for k in keys]
    counts = df.groupBy(*keys, *buckets).agg(F.count(F.lit(1)).alias("_n"))  # at most the buckets of a group
    w = Window.partitionBy(*group)
    offsets = counts.select(*keys, *buckets, F.coalesce(F.sum("_n").over(w.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_size"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*keys, *buckets)]
    joined = df.alias("l").join(offsets.alias("r"), same).select("l.*", "r._before", "r._size")
    inner = F.row_number().over(Window.partitionBy(*keys, *buckets).orderBy(*order))
    out = joined.withColumn(number, F.col("_before") + inner)
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_before", "_size", *buckets)


def number_by_hash(df: DataFrame, keys: list[str], hash_key: Column, id_col: str, number: str, size: str | None = None) -> DataFrame:
    """df with the number, from 1, of each row in its group by (hash_key, id_col), and the size of the group.

    hash_key is a hexadecimal digest: its first digits deal a group's rows evenly.
    """
    marked = df.withColumn("_k", hash_key).withColumn("_bucket", F.substring("_k", 1, 3))
    return _numbered(marked, keys, ["_bucket"], ["_k", id_col], number, size).drop("_k")


def number_by_value(df: DataFrame, keys: list[str], value: str, tie: str, number: str, size: str | None = None) -> DataFrame:
    """df with the number, from 1, of each row in its group by (value, tie), both numbers; nulls come first.

    Bounds of buckets are quantiles of the whole table. A value that fills several of them has buckets of its own, cut by tie.
    """
    cut = lambda c: df.select(F.col(c).cast("double").alias("v")).approxQuantile("v", [i / CUTS for i in range(1, CUTS)], CUT_ERROR)
    values = cut(value)
    often = sorted({v for v, w in zip(values, values[1:]) if v == w})
    ties = sorted(set(cut(tie))) if often else []
    spot = lambda c, cuts: F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda x: x < F.col(c))) if cuts else F.lit(0)
    is_often = F.coalesce(F.col(value).cast("double").isin(often), F.lit(False)) if often else F.lit(False)
    distinct = sorted(set(values))
    # below a bound, then at it where that value is frequent
    marked = df.withColumn("_bucket", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(2 * spot(value, distinct) + is_often.cast("int"))).withColumn("_inner", F.when(is_often, spot(tie, ties)).otherwise(F.lit(0)))
    return _numbered(marked, keys, ["_bucket", "_inner"], [value, tie], number, size)


def paired(left: DataFrame, right: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row of left with every row of a short list, which is read first; a list of more than `most` rows is an error."""
    rows = right.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a list of more than {most} rows can't be paired with a table")
    made = right.sparkSession.createDataFrame(rows, right.schema).agg(F.collect_list(F.struct(*right.columns)).alias("_rows"))
    return left.join(F.broadcast(made)).select(*left.columns, F.explode("_rows").alias("_r")).select(*left.columns, "_r.*")  # one row
