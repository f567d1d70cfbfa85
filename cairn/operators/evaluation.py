"""Scores of extraction models against Gold labels, error taxonomy, judge summaries, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import overlaps
from cairn.operators.numbering import paired
from cairn.operators.selection import values_at


def multiset_counts(gold: DataFrame, predicted: DataFrame, record: str, keys: list[str], tasks: int | None = None) -> DataFrame:
    """tp, fp, fn by record of two multisets of keys; null keys equal each other. tasks: into how many records are dealt."""
    both = gold.select(record, *keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(record, *keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    both = both.repartition(tasks, record) if tasks else both
    by_key = both.groupBy(record, *keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return by_key.groupBy(record).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def prf(counts: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Micro precision, recall and F1 by keys, 0 where there is nothing to divide by."""
    total = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    scored = total.withColumn("p", ratio(tp, tp + fp)).withColumn("r", ratio(tp, tp + fn))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return scored.select(*keys, "tp", "fp", "fn", F.bround("p", digits).alias("precision"), F.bround("r", digits).alias("recall"), F.bround(f1, digits).alias("f1"))


KEY = ("category", "attribute", "sentiment")


def _spans(aspects: Column, text: Column) -> Column:
    """The aspects with the first place of their evidence in the text (0 where it is not there), its length, and their own place."""
    evidence = lambda x: x.getField("evidence")
    listed = F.coalesce(aspects, F.array())
    return F.transform(listed, lambda x, i: F.struct(*[x.getField(k).alias(k) for k in KEY], evidence(x).alias("evidence"), F.coalesce(F.instr(text, evidence(x)), F.lit(0)).alias("s"), F.coalesce(F.length(evidence(x)), F.lit(0)).alias("n"), i.alias("i")))


def _span_iou(a: Column, b: Column) -> Column:
    """exprs.char_iou of two evidences whose places are known."""
    s1, n1, s2, n2 = (x.getField(k) for x in (a, b) for k in ("s", "n"))
    shared = F.greatest(F.least(s1 + n1, s2 + n2) - F.greatest(s1, s2), F.lit(0))
    placed = shared / (F.greatest(s1 + n1, s2 + n2) - F.least(s1, s2))
    return F.when((n1 == 0) | (n2 == 0), 0.0).when((s1 == 0) | (s2 == 0), (a.getField("evidence") == b.getField("evidence")).cast("double")).otherwise(placed)


def _same_key(a: Column, b: Column) -> Column:
    return F.transform(F.array(a, b), lambda x: F.struct(*[x.getField(k) for k in KEY]))[0].eqNullSafe(F.struct(*[b.getField(k) for k in KEY]))


def greedy_overlap(records: DataFrame, least: float = 0.5, raw: str | None = None) -> DataFrame:
    """review_id, tp, fp, fn of one-to-one span matching, folded within the row: no Python, no shuffle.

    records: review_id, review, gold and predicted as array<struct<category, attribute, sentiment, evidence>>. Gold aspects
    take, in their order, the free prediction of their key whose evidence overlaps theirs most (of equal ones the last), if
    that is `least` or more. With `raw`, an array of the same kind, any evidence that gold or raw has for a key will do.
    """
    text = F.coalesce("review", F.lit(""))
    marked = records.select("review_id", _spans(F.col("gold"), text).alias("g"), _spans(F.col("predicted"), text).alias("p"), (_spans(F.col(raw), text) if raw else F.array()).alias("r"))
    said = lambda g: F.filter(F.concat("g", "r"), lambda x: _same_key(x, g) & (x.getField("n") > 0)) if raw else F.array(g)

    def best(used: Column, g: Column) -> Column:
        free = F.filter("p", lambda x: ~F.array_contains(used, x.getField("i")) & _same_key(x, g))
        scored = F.transform(free, lambda x: F.struct(F.coalesce(F.array_max(F.transform(said(g), lambda y: _span_iou(y, x))), F.lit(0.0)).alias("v"), x.getField("i").alias("i")))
        return F.array_max(F.filter(scored, lambda x: x.getField("v") >= least))

    used = F.aggregate("g", F.array().cast("array<int>"), lambda acc, g: F.concat(acc, F.transform(F.array_compact(F.array(best(acc, g))), lambda x: x.getField("i"))))
    tp = F.col("tp")
    return marked.select("review_id", F.size(used).cast("long").alias("tp"), F.size("p").cast("long").alias("n_p"), F.size("g").cast("long").alias("n_g")).select("review_id", "tp", (F.col("n_p") - tp).alias("fp"), (F.col("n_g") - tp).alias("fn"))


def unmatched(gold: DataFrame, predicted: DataFrame, record: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Predictions and Gold rows left over after matching equal keys one to one, in the order of pos."""
    number = lambda df: df.withColumn("_k", F.row_number().over(Window.partitionBy(record, *keys).orderBy("pos")))
    g, p = number(gold), number(predicted)
    same = lambda a, b: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [record, *keys, "_k"]]
    extra = p.alias("a").join(g.alias("b"), same("a", "b"), "left_anti").drop("_k")
    missed = g.alias("a").join(p.alias("b"), same("a", "b"), "left_anti").drop("_k")
    return extra, missed


def extra_kind(in_vocabulary: Column, in_category: Column, attribute_ok: Column, repeated: Column, no_gold: Column, name_in_gold: Column, overlapping: Column) -> Column:
    """The first of eight kinds of wrong prediction that applies."""
    return (
        F.when(~in_vocabulary, "unknown aspect").when(~in_category, "aspect of another category").when(~attribute_ok, "unknown attribute").when(repeated, "repeats a Gold label")
        .when(no_gold, "no Gold label at all").when(name_in_gold, "other attribute or sentiment").when(overlapping, "same evidence, other aspect").otherwise("evidence without a Gold label")
    )


def overlapping_gold(extra: DataFrame, gold: DataFrame, texts: DataFrame, record: str) -> DataFrame:
    """extra with `overlapping`: whether its evidence overlaps one of its record's Gold evidences in the text."""
    spans = gold.groupBy(record).agg(F.collect_list("evidence").alias("_gold"))  # labels of one record
    joined = extra.join(texts, record).join(spans, record, "left")
    return joined.withColumn("overlapping", F.coalesce(F.exists("_gold", lambda g: overlaps(F.col("evidence"), g, F.col("text"))), F.lit(False))).drop("_gold", "text")


def judge_summary(models: DataFrame, judged: DataFrame) -> DataFrame:
    """Items, pass rate and mean score by model; models without a judged row at 0."""
    agg = judged.where("score is not null").groupBy("model").agg(F.count(F.lit(1)).alias("items"), F.bround(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"), F.bround(F.avg("score"), 4).alias("mean_score"))
    return models.join(agg, "model", "left").na.fill(0, ["items"]).na.fill(0.0, ["pass_rate", "mean_score"])


def model_pairs(outputs: DataFrame, record: str, ordinal: str) -> DataFrame:
    """Unordered pairs of models by record, in the order of configuration; few models, so pairs are few."""
    a, b = outputs.alias("a"), outputs.alias("b")
    return a.join(b, (F.col(f"a.{record}") == F.col(f"b.{record}")) & (F.col(f"a.{ordinal}") < F.col(f"b.{ordinal}"))).select(F.col(f"a.{record}").alias(record), F.col("a.model").alias("left_model"), F.col("b.model").alias("right_model"))


def cross_minus_done(left: DataFrame, right: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Combinations of left and of a short list (models) that are not done yet."""
    return paired(left, right).join(done.select(*on), on, "left_anti")


def latency_stats(rows: DataFrame, keys: list[str], order: list[str], warmup: int) -> DataFrame:
    """Requests, mean, p50, p95, min, max by key, without the first warmup rows; order tells a key's rows apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("_o", F.row_number().over(w)).where(F.col("_o") <= warmup)  # the first of each task go on, no more
    until = first.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_until"))
    kept = rows.join(until, keys, "left").where(F.col("_until").isNull() | (F.struct(*order) > F.col("_until"))).drop("_until")
    base = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.bround(F.sum(F.col("latency").cast("decimal(20,6)")).cast("double") / F.count(F.lit(1)), 4).alias("mean"), F.min("latency").alias("min"), F.max("latency").alias("max"))
    rank = lambda share: lambda n: F.bround((n - 1) * share)
    found = values_at(kept, keys, "latency", {"p50": rank(0.5), "p95": rank(0.95)})
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return base.alias("l").join(found.alias("r"), same, "left").select("l.*", "p50", "p95")


def gap_audit(rows: DataFrame, keys: list[str], ts: str, tie: list[str], slow: float) -> DataFrame:
    """Median gap in seconds between successive rows, and how many gaps are longer than slow.

    Rows follow each other within an hour of a key; the first of an hour follows the last of the hour before that has any,
    so no task sorts a key's rows.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = rows.select(*keys, at.alias("_t"), F.floor(at / 3_600_000_000).alias("_hour"), *tie).where("_t is not null")
    hours = marked.groupBy(*keys, "_hour").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    between = hours.select(*keys, (F.col("_first") - F.lag("_last").over(Window.partitionBy(*keys).orderBy("_hour"))).alias("_gap"))
    within = marked.select(*keys, (F.col("_t") - F.lag("_t").over(Window.partitionBy(*keys, "_hour").orderBy("_t"))).alias("_gap"))
    gaps = within.unionByName(between).where("_gap is not null").select(*keys, (F.col("_gap") / 1e6).alias("gap"))
    counts = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("gap") > slow).alias("slow"))
    middle = values_at(gaps, keys, "gap", {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.ceil((n - 1) / 2)})
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return counts.alias("l").join(middle.alias("r"), same).select(*[F.col(f"l.{k}") for k in keys], "gaps", F.bround((F.col("_lo") + F.col("_hi")) / 2, 3).alias("median_gap"), "slow")


def metrics_pivot(metrics: DataFrame, models: list[str]) -> DataFrame:
    """A row per metric, a column per model; metrics that no model has are left out."""
    return metrics.where("value is not null").groupBy("metric").pivot("model", models).agg(F.first("value"))
