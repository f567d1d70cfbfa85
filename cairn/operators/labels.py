"""Cleaning, checking and post-processing of labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import vocab
from cairn.functions.exprs import first_match, map_lookup, py_strip, strip_filler, strip_trailing
from cairn.operators.curation import shortest_evidence

ASPECT = "category string, attribute string, sentiment string, evidence string"
LABEL = f"traveler_context array<string>, aspects array<struct<{ASPECT.replace(' string', ': string')}>>"


def vocabulary(spark: SparkSession) -> DataFrame:
    """category, aspect, attribute: every allowed combination."""
    rows = [(c, a, v) for c, aspects in vocab.ATTRIBUTES.items() for a, values in aspects.items() for v in values]
    return spark.createDataFrame(rows, "category string, aspect string, attribute string")


def vocabulary_sets(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("allowed"))


def normalize_evidence(evidence: Column, review: Column) -> Column:
    """Evidence without filler and end marks, unless that is short or not in the review."""
    short = strip_trailing(strip_filler(py_strip(evidence), vocab.LEADING_FILLERS), ".!?,~…")
    return F.when((F.length(short) < 3) | ~F.contains(review, short), evidence).otherwise(short)


def metric_evidence(evidence: Column) -> Column:
    """The form in which evidences are compared when scored."""
    return F.regexp_replace(py_strip(evidence), r"(?U)[.,!?~…·]*\s*$", "")


def mentions_topic(aspect: Column, evidence: Column) -> Column:
    """Whether the evidence has a word of its aspect's topic; aspects without a rule pass."""
    rule = map_lookup(vocab.TOPIC_WORDS, aspect)
    return rule.isNull() | F.regexp_like(evidence, F.coalesce(rule, F.lit("")))


def unify_aspect(category: Column, attribute: Column, evidence: Column) -> tuple[Column, Column]:
    """(category, attribute) with cleanliness and room condition told apart by the words of the evidence."""
    clean, worn = evidence.rlike(vocab.CLEAN_WORDS), evidence.rlike(vocab.CONDITION_WORDS)
    to_clean = (category == "room_condition") & clean & ~worn
    to_room = (category == "cleanliness") & worn & ~clean
    of_clean = F.when(evidence.rlike(vocab.DIRTY_WORDS), "dirty").otherwise(map_lookup(vocab.ROOM_TO_CLEAN, attribute))
    of_room = map_lookup({v: k for k, v in vocab.ROOM_TO_CLEAN.items()}, attribute)
    return (
        F.when(to_clean, "cleanliness").when(to_room, "room_condition").otherwise(category),
        F.when(to_clean, of_clean).when(to_room, of_room).otherwise(attribute),
    )


def parking_value(text: Column) -> Column:
    return first_match([(text.rlike("불가|없음"), "unavailable"), (text.rlike("가능|있음"), "available")])


def weather_value(class_code: Column) -> Column:
    return map_lookup(vocab.WEATHER_BY_CLASS, F.substring(class_code, 1, 4))


def stay_value(class_code: Column) -> Column:
    return map_lookup(vocab.STAY_BY_CLASS, F.substring(class_code, 1, 4))


def place_aspect(aspect: str, field: str, value: Column, fact: Column) -> Column:
    """A neutral label whose evidence is a fact of the place; null without a value."""
    return F.when(value.isNotNull(), F.struct(F.lit(aspect).alias("category"), value.alias("attribute"), F.lit("neutral").alias("sentiment"), F.concat(F.lit(f"place:{field}="), fact).alias("evidence")))


def with_place_aspects(records: DataFrame) -> DataFrame:
    """records (category, parking, class_code, aspects) with the rule labels of aspects that the review does not mention."""
    made = [("parking_availability", "parking", parking_value(F.col("parking")), F.col("parking"), vocab.CATEGORIES), ("weather_sensitivity", "class_code", weather_value(F.col("class_code")), F.col("class_code"), ["attraction"]), ("stay_duration", "class_code", stay_value(F.col("class_code")), F.col("class_code"), ["attraction"])]
    extra = F.array_compact(F.array(*[F.when(F.col("category").isin(kinds) & ~F.array_contains(F.transform("aspects", lambda a: a.category), name), place_aspect(name, field, value, fact)) for name, field, value, fact, kinds in made]))
    return records.withColumn("aspects", F.concat("aspects", extra))


def review_only(aspects: Column) -> Column:
    """Aspects whose evidence is from the review, not from the place."""
    return F.filter(aspects, lambda a: ~F.coalesce(a.evidence.startswith("place:"), F.lit(False)))


def positive_only(aspects: Column) -> Column:
    return F.coalesce(F.array_distinct(F.transform(aspects, lambda a: a.sentiment)) == F.array(F.lit("positive")), F.lit(False))


def place_fact_holds(evidence: Column, facts: Column) -> Column:
    """Whether evidence of the form place:<field>=<value> is what the map says."""
    body = F.substring(evidence, F.lit(7), F.length(evidence))
    return F.coalesce(F.try_element_at(facts, F.substring_index(body, "=", 1)) == F.regexp_extract(body, "(?s)=(.*)$", 1), F.lit(False))


def aspect_problem(aspects: DataFrame, vocabulary_: DataFrame, topic: bool = False) -> DataFrame:
    """aspects (record, kind, category, attribute, sentiment, evidence, review) with `problem`: the first rule broken."""
    names = vocabulary_.select(F.col("category").alias("kind"), F.col("aspect").alias("category")).distinct().withColumn("_a", F.lit(True))
    values = vocabulary_.select(F.col("category").alias("kind"), F.col("aspect").alias("category"), "attribute").distinct().withColumn("_v", F.lit(True))
    seen = aspects.join(F.broadcast(names), ["kind", "category"], "left").join(F.broadcast(values), ["kind", "category", "attribute"], "left")
    rules = [
        (F.col("_a").isNull(), "aspect"), (F.col("_v").isNull(), "attribute"), (~F.coalesce(F.col("sentiment").isin(vocab.SENTIMENTS), F.lit(False)), "sentiment"),
        (F.coalesce(py_strip(F.col("evidence")), F.lit("")) == "", "no evidence"), (~F.contains("review", "evidence"), "evidence not in review"),
    ]
    if topic:
        rules.append((~mentions_topic(F.col("category"), F.col("evidence")), "off topic"))
    return seen.withColumn("problem", first_match(rules)).drop("_a", "_v")


def check_records(records: DataFrame) -> DataFrame:
    """records with `problems`: every rule on the record itself that is broken."""
    rules = [
        (F.col("review_id").isNull(), "review_id missing"), (F.col("place_id").isNull(), "place_id missing"), (F.coalesce(py_strip(F.col("review")), F.lit("")) == "", "review blank"),
        (~F.coalesce(F.col("category").isin(vocab.CATEGORIES), F.lit(False)), "category unknown"), (F.coalesce(F.col("review").rlike("<0x[0-9A-F]{2}>"), F.lit(False)), "broken bytes"), (F.col("synthetic").isNull(), "synthetic missing"),
    ]
    return records.withColumn("problems", F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules])))


def clean_split(aspects: DataFrame) -> DataFrame:
    """aspects (record, kind, pos, category, attribute, sentiment, evidence, review) normalised, unified, deduplicated."""
    step = aspects.withColumn("evidence", normalize_evidence(F.col("evidence"), F.col("review")))
    category, attribute = unify_aspect(F.col("category"), F.col("attribute"), F.col("evidence"))
    hotel = F.col("kind") == "hotel"
    step = step.withColumns({"category": F.when(hotel, category).otherwise(F.col("category")), "attribute": F.when(hotel, attribute).otherwise(F.col("attribute"))})
    return shortest_evidence(step, "record")


# Fixed patterns of JSON: a string, and an object with up to four levels of brackets within it.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _object_pattern(levels: int) -> str:
    inner = "(?!)"
    for _ in range(levels):
        inner = rf"[\[{{](?:[^\[\]{{}}\"]++|{STRING}|{inner})*+[\]}}]"
    return rf"\{{(?:[^\[\]{{}}\"]++|{STRING}|{inner})*+\}}"


OBJECT = _object_pattern(4)


def _is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def whole_object(text: Column) -> Column:
    """text without white space around it where that is one JSON object, else null."""
    stripped = F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(_is_object(stripped), stripped)


def salvaged_label(text: Column) -> Column:
    """A label as JSON from the aspects that a cut-off text holds whole; null where its list of aspects never begins.

    Objects are read one after the other from the first bracket behind "aspects"; what is no object is passed over, and the
    first that does not end, or is no JSON, ends the reading. Contexts are those of the first list of that name, none where
    that is no JSON. Aspects may hold up to four levels of brackets.
    """
    at = F.instr(text, F.lit('"aspects"'))
    rest = F.substring(text, at, F.length(text))
    bracket = F.instr(rest, F.lit("["))
    body = F.substring(rest, bracket + 1, F.length(rest))
    found = F.regexp_extract_all(body, F.lit(rf"(?s)\G[^{{]*+({OBJECT})"), F.lit(1))
    bad = F.array_position(F.transform(found, _is_object), F.lit(False))  # the first object that is none
    kept = F.when(bad > 0, F.slice(found, F.lit(1), F.greatest(bad - 1, F.lit(0)).cast("int"))).otherwise(found)
    listed = F.nullif(F.regexp_extract(text, r'"traveler_context"\s*:\s*(\[[^\]]*\])', 1), F.lit(""))
    contexts = F.when(F.try_parse_json(listed).isNotNull(), listed).otherwise(F.lit("[]"))
    label = F.concat(F.lit('{"traveler_context": '), contexts, F.lit(', "aspects": ['), F.array_join(kept, ", "), F.lit("]}"))
    return F.when((at > 0) & (bracket > 0), label)


def with_salvaged(df: DataFrame, column: str = "raw_output") -> DataFrame:
    """df with json_valid, salvaged (whether a broken output gave a label) and label_json; a null output gives none."""
    whole = whole_object(F.col(column))
    label = F.coalesce(whole, salvaged_label(F.col(column)))
    return df.withColumns({"json_valid": whole.isNotNull(), "salvaged": whole.isNull() & label.isNotNull(), "label_json": label})


def decoded_bytes(text: Column) -> Column:
    """Runs of <0xNN> tokens as the UTF-8 they spell; runs that spell none stay."""
    spelled = lambda p: F.try_validate_utf8(F.unhex(F.regexp_replace(p, "<0x|>", "")).cast("string"))
    pieces = F.regexp_extract_all(text, F.lit(r"((?:<0x[0-9A-F]{2}>)+|[^<]+|<)"), F.lit(1))
    joined = F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("<0x"), F.coalesce(spelled(p), p)).otherwise(p)), "")
    return F.when(text.rlike("<0x[0-9A-F]{2}>"), joined).otherwise(text)


def with_decoded_bytes(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, decoded_bytes(F.col(column)))


def map_rows(df: DataFrame, client, columns: list[str], out: str, attempts: int = 1, accept=None) -> DataFrame:
    """df with out = client(dict of columns): a row-wise external call, as of a model.

    A failure, or an answer that accept refuses (broken text, say), is tried again up to `attempts` times; then out is
    null and `<out>_error` says why.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def call(row: dict) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                got = client(row)
            except Exception as e:  # noqa: BLE001  the client is foreign code; its failure is a row's failure
                error = f"{type(e).__name__}: {e}"
                continue
            if accept is None or accept(got):
                return got, None
            error = "refused"
        return None, error

    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            got = [call(row) for row in pdf[columns].to_dict("records")]
            yield pdf.assign(**{out: [g for g, _ in got], f"{out}_error": [e for _, e in got]})

    return df.mapInPandas(run, f"{kind}, `{out}` string, `{out}_error` string")
