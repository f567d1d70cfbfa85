"""Exact order statistics of groups of any size: values at given places of a group's order, and no task sorts a large group.

A group of up to `limit` rows is sorted in a task. For a larger one each place has a bracket of values that holds it: a
sketch of the bracket's rows gives cuts, rows are counted between and at the cuts, and the count that the place falls into
is the next bracket, until that is one value or holds few rows. Counts are exact, so sketches decide the number of rounds
only: each makes a bracket about CUTS times smaller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import discard, materialize

#: Rows of a group that one task may sort; cuts of a bracket; groups up to which brackets are broadcast.
SORTED_ROWS, CUTS, BROADCAST_ROWS = 200_000, 128, 100_000


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast where a count says that it is short."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _inside(rows: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """rows with each bracket of their group that holds them."""
    held = rows.alias("l").join(_small(brackets).alias("r"), _same(keys))
    return held.where("r._lo <= l._v and l._v <= r._hi").select("l.*", *[f"r.{c}" for c in brackets.columns if c not in keys])


def _narrowed(rows: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """For every bracket the part of it, between two cuts or at one, that holds its place."""
    which = [*keys, "_name"]
    grid = [i / CUTS for i in range(1, CUTS)]
    inside = _inside(rows, keys, brackets)
    cuts = inside.groupBy(*which).agg(F.array_distinct(F.percentile_approx("_v", grid, 8 * CUTS)).alias("_cuts"))
    met = inside.alias("l").join(_small(cuts).alias("r"), _same(which)).select("l.*", "r._cuts")
    spot = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
    counts = met.groupBy(*which, "_at", "_below", spot.alias("_spot")).agg(F.count(F.lit(1)).alias("_held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))  # 2 * CUTS a bracket
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(*which).orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("_below", F.col("_below") + before).where("_below <= _at and _at < _below + _held").select(*brackets.columns)


def values_at(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], limit: int = SORTED_ROWS) -> DataFrame:
    """keys and, for every name of places, the value at that place (from 0, a function of the group's size) in ascending order.

    Null values do not count; a place outside a group gives null; null keys are a group. Values are numbers or times.
    """
    rows = df.select(*keys, F.col(value).alias("_v")).where("_v is not null")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), place(F.col("_n")).cast("long").alias("_at")) for name, place in places.items()])).alias("_p")
    large = sizes.where(F.col("_n") > limit)
    found, written = [sizes.select(*keys, F.lit(None).cast("string").alias("_name"), F.lit(None).cast(rows.schema["_v"].dataType).alias("_v"))], []  # every group has a row
    if large.limit(1).count():
        brackets = large.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_held"), at).select(*keys, "_p._name", "_p._at", "_below", "_held", "_lo", "_hi").where("_at >= 0 and _at < _held")
        written.append(materialize(brackets, "brackets"))
        done = (F.col("_lo") == F.col("_hi")) | (F.col("_held") <= limit)
        while True:
            now = written[-1]
            found.append(now.where("_lo = _hi").select(*keys, "_name", F.col("_lo").alias("_v")))
            few = now.where((F.col("_lo") < F.col("_hi")) & (F.col("_held") <= limit))
            if few.limit(1).count():
                order = F.row_number().over(Window.partitionBy(*keys, "_name").orderBy("_v")) - 1
                found.append(_inside(rows, keys, few).withColumn("_i", order).where("_i = _at - _below").select(*keys, "_name", "_v"))
            rest = now.where(~done)
            if not rest.limit(1).count():
                break
            written.append(materialize(_narrowed(rows, keys, rest), "brackets"))
        rows = rows.alias("l").join(_small(large.select(*keys)).alias("r"), _same(keys), "left_anti")
    sorted_ = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    found.append(sorted_.select(*keys, "_v", "_i", at).where("_i = _p._at").select(*keys, "_p._name", "_v"))
    picked = found[0]
    for f in found[1:]:
        picked = picked.unionByName(f)
    out = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])
    if written:
        out = materialize(out, "places")
        for w in written:
            discard(w)
    return out
