"""Mappers from source records to rows, small parsers (PF14-PF16, PF28, F10, F11, F34, X2, X11-X13, X22, X24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import vocab
from cairn.functions.exprs import blank_to_null, first_match, py_strip
from cairn.operators import labels
from cairn.operators.datasets import first_labels


def pairs_map(text: Column) -> Column:
    """`a=1,b=2` as a map of whole numbers; parts without a number are left out."""
    parts = F.filter(F.split(text, ","), lambda x: F.regexp_like(x, F.lit(r"^\s*[^=]+=\s*\d+\s*$")))
    return F.map_from_entries(F.array_distinct(F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring_index(x, "=", -1)).cast("int").alias("v")))))


def name_and_path(text: Column) -> tuple[Column, Column]:
    """`name=path`: what stands before and after the first `=`; without one, the whole is the name."""
    return F.substring_index(text, "=", 1), F.regexp_extract(text, "(?s)=(.*)$", 1)


def name_and_label(text: Column) -> tuple[Column, Column]:
    """`name::label`, the label empty where there is none."""
    return F.substring_index(text, "::", 1), F.regexp_extract(text, "(?s)::(.*)$", 1)


def prefixed_id(fields: list[tuple[str, Column]]) -> Column:
    """`source:id` of the first field that has a value; a value with a colon has its source already."""
    value = lambda c: blank_to_null(c.cast("string"))
    return first_match([(value(c).isNotNull(), F.when(F.contains(value(c), F.lit(":")), value(c)).otherwise(F.concat(F.lit(f"{name}:"), value(c)))) for name, c in fields])


def whole_number(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int"))


def metric(result: Column, path: str) -> Column:
    """The number at a path of a JSON result, null where there is none or no number; true and false count as 1 and 0."""
    value = F.try_variant_get(F.try_parse_json(result), path, "string")
    return F.coalesce(value.try_cast("double"), F.when(value == "true", F.lit(1.0)).when(value == "false", F.lit(0.0)))


def location_row(record: Column) -> Column:
    """struct<name, lat, lng, review_count, fetched> of a location object in JSON; of one that is missing, fetched is true."""
    v = F.try_parse_json(record)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return F.struct(get("$.name", "string").alias("name"), get("$.coordinates.latitude", "double").alias("lat"), get("$.coordinates.longitude", "double").alias("lng"), F.coalesce(get("$.overall_rating.count", "int"), F.lit(0)).alias("review_count"), v.isNull().alias("fetched"))


def service_error(text: Column) -> Column:
    """What a response that is no JSON says: the message of a refused key or limit, which stops a source, or that it is no JSON."""
    said = F.regexp_extract(text, "(?s)<returnAuthMsg>(.*?)</returnAuthMsg>", 1)
    return F.when(F.try_parse_json(text).isNotNull(), F.lit(None)).when(text.rlike("(?s)<returnAuthMsg>.*</returnAuthMsg>"), F.concat(F.lit("stop: "), said)).otherwise(F.lit("no JSON"))


def normalized_test(aspects: DataFrame) -> DataFrame:
    """Aspects of test records with their evidence normalised only, and `pending_approval` where that changed it."""
    step = aspects.withColumn("_e", labels.normalize_evidence(F.col("evidence"), F.col("review")))
    return step.withColumn("normalization", F.when(~F.col("evidence").eqNullSafe(F.col("_e")), "pending_approval")).withColumn("evidence", F.col("_e")).drop("_e")


def preference_counts(choices: DataFrame, column: str, default: str) -> DataFrame:
    """How often each choice was made; a missing one counts as the default."""
    return choices.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias("choice")).agg(F.count(F.lit(1)).alias("n"))


def most_reviewed(places: DataFrame, counts: DataFrame, group: str, n: int) -> DataFrame:
    """The n places of each group with the most reviews; ties go to the least place_id."""
    w = Window.partitionBy(group).orderBy(F.desc("reviews"), "place_id")
    joined = places.join(counts, "place_id", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def candidate_categories(rows: DataFrame, name: str, label: str, pos: str, words: Column) -> DataFrame:
    """rows with `category`: what their own label, else the first label of their name, says; null where neither does."""
    known = rows.join(first_labels(rows, name, label, pos), name, "left")
    return known.withColumn("_label", F.coalesce(F.nullif(F.col(label), F.lit("")), "known_label")).withColumn("category", words).drop("_label", "known_label")


def review_row(record: Column, place: list[str], text: list[str]) -> Column:
    """struct<place, review, review_id> of a JSON record under any of its source's names; null without a text. Who wrote it is not kept."""
    v = F.try_parse_json(record)
    first = lambda names: F.coalesce(*[blank_to_null(F.try_variant_get(v, f"$.{n}", "string")) for n in names])
    row = F.struct(first(place).alias("place"), first(text).alias("review"), F.substring(F.sha1(F.concat_ws("|", first(place), first(text))), 1, 12).alias("review_id"))
    return F.when(first(text).isNotNull(), row)


def convert_each(df: DataFrame, column: str, convert: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(df with the converted record in `name`, rows that can't be converted with `error`): broken records are set apart,
    those that convert to nothing are dropped."""
    parsed = F.try_parse_json(F.col(column))
    error = F.when(parsed.isNull(), "no JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "no object")
    marked = df.withColumn("error", error)
    return marked.where("error is null").withColumn(name, convert).where(F.col(name).isNotNull()).drop("error"), marked.where("error is not null")


def label_aspects(label: Column) -> Column:
    """The objects in the aspects of a label in JSON, each as JSON; a label or a list of another type counts as empty."""
    listed = F.try_variant_get(F.try_parse_json(label), "$.aspects", "array<variant>")
    objects = F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda a: F.coalesce(F.schema_of_variant(a).startswith("OBJECT"), F.lit(False)))
    return F.transform(objects, lambda a: F.to_json(a))


# Names under which sources have a review's text.
REVIEW_TEXT_FIELDS = ["text", "review", "content", "body"]


def review_records(places: DataFrame, reviews: str = "reviews", text: list[str] = REVIEW_TEXT_FIELDS) -> DataFrame:
    """The reviews within places as records of one form, whatever their source calls things.

    places: place_id, category, sources (array), and a JSON array of reviews. A review has the id `source_id`, or
    `place#index` with its place in the array where it has none. What is no object, or has no text, is left out; the rating
    and the like stay as JSON values of any type. Arrays are taken apart within their row, so the index needs no shuffle.
    """
    listed = F.try_variant_get(F.try_parse_json(reviews), "$", "array<variant>")
    rows = places.select("place_id", "category", F.get("sources", F.lit(0)).alias("source"), F.posexplode(listed).alias("_i", "_v")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    get = lambda name: F.try_variant_get(F.col("_v"), f"$.{name}", "string")
    given = lambda *names: F.coalesce(*[F.nullif(get(n), F.lit("")) for n in names])
    is_text = lambda name: F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{name}", "variant")) == "STRING"
    # the first name with a value counts, even if that is no text
    said = first_match([(F.nullif(get(n), F.lit("")).isNotNull() & (get(n) != "[]"), F.when(is_text(n), get(n))) for n in text])
    own_id, language, original = given("review_id", "id"), get("language"), get("source_language")
    return rows.select(
        F.coalesce(F.when(own_id.isNotNull(), F.concat(F.coalesce("source", F.lit("")), F.lit("_"), own_id)), F.concat("place_id", F.lit("#"), F.col("_i").cast("string"))).alias("review_id"),
        "place_id", "category", F.lit(False).alias("synthetic"), "source", py_strip(said).alias("review"), get("title").alias("title"), get("rating").alias("rating"), get("trip_type").alias("trip_type"),
        given("published_date", "publish_ts", "date").alias("published"), language.alias("language"),
        (F.coalesce(F.contains(get("translation_status"), F.lit("translat")), F.lit(False)) | (original.isNotNull() & ~original.eqNullSafe(language))).alias("translated"),
    ).where(F.col("review") != "")
