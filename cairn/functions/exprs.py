"""Column expressions with the reference semantics: rounding half to even, Unicode white space, guarded division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def py_round(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def blank_to_null(c: Column) -> Column:
    return F.nullif(py_strip(c), F.lit(""))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one digit; 0 where there is no whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, 1)).otherwise(F.lit(0.0))


def hash_rank_key(seed: str, c: Column) -> Column:
    """The order of seeded sampling: SHA-256 of seed:id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def map_lookup(table: dict, c: Column) -> Column:
    """table[c], null where it has no such key, in the order the table lists."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def first_match(rules: list[tuple[Column, object]]) -> Column:
    out = None
    for test, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


# ---- text ----


def clean(c: Column) -> Column:
    """Tags become spaces, runs of white space one space; null where nothing is left."""
    return F.nullif(py_strip(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " ")), F.lit(""))


def clean_phone(c: Column) -> Column:
    return F.replace(clean(c), F.lit(" "), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Key of a name: without white space, brackets and separators, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s()\[\]·,.\-]", ""))


def name_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\(.*?\)|\s", ""))


def address_head(c: Column) -> Column:
    return F.element_at(F.split(c, "[,(]"), 1)


def road_key(address: Column) -> Column:
    """Road and number of an address, null where it has none."""
    glued = F.regexp_replace(address_head(address), r"(?U)\s+(\d+번길)", "$1")
    rule = r"(?U)([가-힣0-9]+(?:로|길))\s+(\d+(?:-\d+)?)"
    road, number = F.regexp_extract(glued, rule, 1), F.regexp_extract(glued, rule, 2)
    return F.when(road != "", F.concat_ws(" ", road, number))


def first_word_in(c: Column, table: dict) -> Column:
    """The value of the first word of c that the table has."""
    hits = F.filter(F.split(c, r"(?U)\s+"), lambda w: map_lookup(table, w).isNotNull())
    return map_lookup(table, F.get(hits, F.lit(0)))


def first_part_of(c: Column, table: dict) -> Column:
    """The value of the first key, in the table's order, that c contains."""
    return first_match([(F.contains(c, F.lit(k)), v) for k, v in table.items()])


def strip_filler(c: Column, fillers: list[str]) -> Column:
    """Without one leading filler word and the blanks and commas after it."""
    longest = sorted(fillers, key=len, reverse=True)
    return F.regexp_replace(c, f"^(?:{'|'.join(longest)}) [ ,]*", "")


def strip_trailing(c: Column, marks: str) -> Column:
    """Without white space, one run of marks, and white space, at the end."""
    return F.regexp_replace(c, rf"(?U)(?:\s*[{marks}]+)?\s*$", "")


def keyed_map(pairs: list[tuple[str, Column]]) -> Column:
    """Map of the pairs whose cleaned value is not empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), blank_to_null(v).alias("v")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e.getField("v").isNotNull()))


# ---- geometry and spans ----


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(a))


def char_iou(a: Column, b: Column, text: Column) -> Column:
    """Overlap over union of the first places of a and b in text; where one is not found, whether they are equal."""
    s1, s2 = F.instr(text, a), F.instr(text, b)
    e1, e2 = s1 + F.length(a), s2 + F.length(b)
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0)) / (F.greatest(e1, e2) - F.least(s1, s2))
    missing = F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0
    return F.when(missing, F.lit(0.0)).when((s1 == 0) | (s2 == 0), F.when(a == b, 1.0).otherwise(0.0)).otherwise(both)


def overlaps(a: Column, b: Column, text: Column) -> Column:
    s1, s2 = F.instr(text, a), F.instr(text, b)
    return F.coalesce((s1 > 0) & (s2 > 0) & (s1 < s2 + F.length(b)) & (s2 < s1 + F.length(a)), F.lit(False))


# ---- JSON ----


def json_object(c: Column) -> Column:
    """c where it holds a whole JSON object, else null."""
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), c)


def json_slice(c: Column) -> Column:
    """From the first { to the last }, where that is a JSON object."""
    return json_object(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")))
