"""Steps whose figures must not grow faster than their input."""

import time

from pyspark.sql import functions as F

from cairn.operators import components as components_module
from cairn.operators import curation, profile


def test_nearest_of_rows_that_share_spots(spark):
    """Spots meet, not rows: 1.6e9 pairs of rows stand at one spot here."""
    at = lambda n, more: spark.range(n).select("id", F.lit("c").alias("category"), F.lit(35.0).alias("lat"), (F.lit(129.0) + F.when(F.col("id") < more, 0.001).otherwise(0.0)).alias("lng"))
    began = time.time()
    got = curation.nearest_within(at(40_000, 3), at(40_000, 0).where("id > 6"), 1.5)
    assert tuple(got.agg(F.count("*"), F.min("right_id"), F.max("right_id"), F.count_if(F.col("km") > 0)).first()) == (40_000, 7, 7, 3)
    assert time.time() - began < 60


def test_rounds_of_components_send_no_table_to_the_driver(spark, monkeypatch):
    """Beyond the counted sizes no join of a round is a broadcast, however short the files are."""
    monkeypatch.setattr(components_module, "BROADCAST_ROWS", 10)
    plans = []
    written = components_module.materialize
    monkeypatch.setattr(components_module, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df, name))
    edges = spark.range(1, 2000).select(F.col("id").alias("a"), F.col("id").bitwiseAND(-16).alias("b"))
    got = components_module.components(edges, "a", "b")
    assert got.where(F.col("component") != F.greatest(F.col("node").bitwiseAND(-16), F.lit(0))).count() == 0
    rounds = [p for p in plans if "Join" in p]
    assert rounds and all(0 < p.count("BroadcastHashJoin") <= 2 * p.count("SortMergeJoin") for p in rounds)  # hubs meet both sides of a star


def test_entities_are_joined_without_broadcasts(spark):
    p = spark.range(50).selectExpr("id AS place_id", "'x' AS category", "CAST(NULL AS STRING) AS district", "'' AS address", "concat('n', id % 7) AS name")
    assert "Broadcast" not in curation.entity_edges(p)._jdf.queryExecution().executedPlan().toString()
    got = {r.place_id: r.group for r in curation.connected_groups(p, curation.entity_edges(p), "place_id").collect()}
    assert got == {k: k % 7 for k in range(50)}


def test_merged_spans_of_equal_spans(spark):
    """Equal spans are ties of the windows; whatever their order, the merged spans are the same."""
    rows = [(1, 0, 10)] * 50 + [(1, 10, 20)] * 50 + [(1, 21, 30)] * 50 + [(1, 21, 25)] * 50
    df = spark.createDataFrame(rows, "u int, start long, stop long")
    for parts in (1, 3, 17):
        assert {tuple(r) for r in profile.merged_spans(df.repartition(parts), ["u"]).collect()} == {(1, 0, 20), (1, 21, 30)}


def test_merged_spans_without_bounds(spark):
    """Missing bounds come last, as in the SQL, and make no row of their own beside a key's other spans."""
    df = spark.createDataFrame([(1, None, None), (1, None, None), (1, 0, 10), (1, 10, 20), (1, 21, 30), (2, None, None)], "u int, start long, stop long")
    assert sorted(map(tuple, profile.merged_spans(df, ["u"]).collect()), key=str) == [(1, 0, 20), (1, 21, 30), (2, None, None)]


def test_tables_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """A task gets so many rows, not a share of the table that grows with it."""
    from cairn import session
    from cairn.operators import evaluation
    from cairn.plans import star

    d = "/root/testdata/sf0.001"
    rows = session.table(spark, d, "lineitem").count()
    monkeypatch.setattr(session, "ROWS_A_TASK", rows // 40)
    tasks = session.tasks_for(session.table(spark, d, "lineitem"))
    assert tasks in (40, 41)
    assert star.companions(spark, d).rdd.getNumPartitions() == tasks
    assert star.annotated(spark, d).rdd.getNumPartitions() == tasks
    one = spark.range(200).selectExpr("id % 50 AS id", "'a' AS k")
    counts = evaluation.multiset_counts(one, one.where("id < 7"), "id", ["k"], tasks)
    assert counts.rdd.getNumPartitions() == tasks
    assert tuple(counts.agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()) == (28, 0, 172)
