"""Readers of line-delimited and array JSON, CSV and spreadsheets (SRC1-SRC9)."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairn.streaming.logs import exists

CORRUPT = "_corrupt_record"
#: Splits of files up to which their line offsets are broadcast.
BROADCAST_SPLITS = 100_000


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """One object per line; a bad line fails the read. With missing_ok an absent file is an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line, of files of any size: their splits are read by many tasks.

    Rows of a task are numbered as they come; the first number of a split and the lines of the splits before it, one row a
    split, make line numbers of these.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "_start", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    offsets = F.broadcast(offsets) if offsets.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS else offsets
    return rows.join(offsets, ["file", "_start"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, and the error names file and line, also of lines that are JSON but no object. Blank lines count as lines only."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    bad = F.coalesce(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(True))
    checked = F.when(bad, F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" JSON error"))).cast("string")).otherwise(F.col("value"))
    return rows.select(F.from_json(checked, schema).alias("r")).select("r.*")


def read_jsonl_permissive(spark: SparkSession, path: str, schema: StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, invalid): the last record of every key, and the lines that are broken or have no key."""
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(path, mode="PERMISSIVE")
    pos = rows.withColumn("_pos", F.struct(F.input_file_name(), F.monotonically_increasing_id()))  # order within a file
    good = F.col(CORRUPT).isNull() & F.col(key).isNotNull()
    last = pos.where(good).groupBy(key).agg(F.max_by(F.struct(*schema.fieldNames()), "_pos").alias("r")).select("r.*")
    return last, pos.where(~good).drop("_pos")


def read_places(spark: SparkSession, glob: str, schema: str, key: str = "place_id") -> DataFrame:
    """Records of all JSON arrays that the pattern names; the last file, by name, wins a key."""
    rows = spark.read.option("multiLine", True).schema(schema).json(glob).withColumn("_file", F.input_file_name())
    names = [c for c in rows.columns if c != "_file"]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "_file").alias("r")).select("r.*")


def records_in(df: DataFrame, column: str) -> DataFrame:
    """df with `record`, as JSON: the objects in an array, or in those arrays of an object whose first element is an object;
    of an object without such an array, the object itself. Rows that hold none are left out."""
    objects = lambda items: F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))
    listed = F.try_variant_get(F.col("_v"), "$", "array<variant>")
    held = F.map_values(F.coalesce(F.try_variant_get(F.col("_v"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    lists = F.filter(F.transform(F.filter(held, lambda x: F.coalesce(F.schema_of_variant(x).startswith("ARRAY"), F.lit(False))), lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: F.coalesce(F.schema_of_variant(F.get(x, F.lit(0))).startswith("OBJECT"), F.lit(False)))
    kind = F.schema_of_variant("_v")
    inner = F.when(F.size(lists) > 0, F.flatten(F.transform(lists, objects))).otherwise(F.array("_v"))
    found = F.when(kind.startswith("ARRAY"), objects(listed)).when(kind.startswith("OBJECT"), inner)
    return df.select("*", F.try_parse_json(column).alias("_v")).select(*df.columns, F.explode(found).alias("_r")).select(*df.columns, F.to_json("_r").alias("record"))


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8-sig", "cp949")) -> DataFrame:
    """CSV files of one header, each in the first of the encodings that its bytes allow; all columns are strings.

    Spark's own reader takes few encodings, so files (registers of a few MB) are decoded whole, one task each.
    """

    def decoded(content: bytes) -> str:
        for encoding in encodings:
            try:
                return content.decode(encoding)
            except UnicodeDecodeError:
                continue
        raise ValueError(f"a file of {path} is in none of {', '.join(encodings)}")

    def parse(content: bytes) -> pd.DataFrame:
        return pd.read_csv(io.StringIO(decoded(content)), dtype=str, keep_default_na=False, na_values=[""])

    def header(it):
        for pdf in it:
            for content in pdf["content"]:
                yield pd.DataFrame({"name": list(pd.read_csv(io.StringIO(decoded(content)), dtype=str, nrows=0).columns)})

    raw = spark.read.format("binaryFile").load(path).select("content")
    names = [r.name for r in raw.limit(1).mapInPandas(header, "name string").collect()]

    def rows(it):
        for pdf in it:
            for content in pdf["content"]:
                yield parse(content)[list(names)].astype(object).where(lambda x: x.notna(), None)

    return raw.mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))


def read_csv_positional(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The first columns of a CSV by position, whatever its header says."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def file_with_prefix(names: list[str], prefix: str) -> str | None:
    """The first name that begins with prefix, however either is composed (NFC)."""
    nfc = lambda s: unicodedata.normalize("NFC", s)
    return next((n for n in sorted(names) if nfc(n).startswith(nfc(prefix))), None)


# Namespaces of workbook files.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """Elements of that tag of one part of the workbook, each let go of once it was used."""
    with book.open(name) as part:
        for _, e in ElementTree.iterparse(part):
            if e.tag.endswith("}" + tag):
                yield e
                e.clear()


def _sheet_rows(content: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Rows of the sheet as it stores them: text as it is, numbers (dates too) as digits, True and False."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        relation = next((e.get(f"{RELATION}id") for e in _elements(book, "xl/workbook.xml", "sheet") if e.get("name") == sheet), None)
        if relation is None:
            raise ValueError(f"a workbook has no sheet {sheet!r}")
        target = next(e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship") if e.get("Id") == relation)
        shared = ["".join(t.text or "" for t in e.iter(f"{MAIN}t")) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        for row in _elements(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}", "row"):
            out: list[str | None] = []
            for cell in row.findall(f"{MAIN}c"):
                if place := re.match("[A-Z]+", cell.get("r", "")):
                    column = 0
                    for letter in place[0]:
                        column = 26 * column + ord(letter) - 64
                    out += [None] * (column - 1 - len(out))
                value, kind = cell.findtext(f"{MAIN}v"), cell.get("t")
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                elif kind == "b":
                    value = str(value == "1")
                out.append(value)
            yield out


def read_sheet(spark: SparkSession, path: str, sheet: str, batch: int = 1000) -> DataFrame:
    """Rows of a sheet of all workbooks that path names, under the header that is their first row, all as strings.

    Executors read the workbooks, a task each, and their rows as they come: a task holds the compressed file, its table of
    shared texts and `batch` rows. Rows without a value are left out; files may have their columns in other orders, and
    columns that a file lacks are null in its rows.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")

    def headers(it):
        for pdf in it:
            for content in pdf["content"]:
                yield pd.DataFrame({"name": [n for n in next(_sheet_rows(content, sheet), []) if n], "at": [i for i, n in enumerate(next(_sheet_rows(content, sheet), [])) if n]})

    names = [r.name for r in raw.mapInPandas(headers, "name string, at int").groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]  # column names
    if not names:
        return spark.createDataFrame([], "`_` string").drop("_")

    def rows(it):
        for pdf in it:
            for content in pdf["content"]:
                found = _sheet_rows(content, sheet)
                header = next(found, [])
                held: list[dict] = []
                for r in found:
                    if any(v is not None and v != "" for v in r):
                        held.append({n: v for n, v in zip(header, r) if n})
                    if len(held) >= batch:
                        yield pd.DataFrame(held, columns=names).astype(object).where(lambda x: x.notna(), None)
                        held = []
                yield pd.DataFrame(held, columns=names).astype(object).where(lambda x: x.notna(), None)

    return raw.mapInPandas(rows, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))


def aliased(columns: list[str], aliases: list[str]) -> tuple[Column, Column]:
    """Value of the first alias that has one, and that alias; missing are null and empty text only."""
    known = [a for a in aliases if a in columns]
    value = lambda a: F.nullif(F.col(a).cast("string"), F.lit(""))
    if not known:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return F.coalesce(*map(value, known)), F.coalesce(*[F.when(value(a).isNotNull(), F.lit(a)) for a in known])
