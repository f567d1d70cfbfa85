"""Paged lookups as a Python data source, calls under a source-wide budget and breaker, read-through details, and a plan of
calls (SRC11-SRC17, ST5)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.operators.numbering import paired
from cairn.session import materialize
from cairn.streaming.logs import append_new, exists

PAGE_ROWS, MAX_PAGES = 100, 20


class PagedRequest(InputPartition):
    def __init__(self, request: dict):
        self.request = request


class Truncated(Exception):
    """A source has more items than the pages that may be fetched hold."""


class Unavailable(Exception):
    """A source failed several times in a row."""


def items_of(got: dict) -> list:
    """The items of a response; an empty string, null or no field means none, a single object is one item."""
    items = got.get("items") or []
    return [items] if isinstance(items, dict) else list(items)


def scrubbed(message: str, secrets: list[str]) -> str:
    """A service's message without keys and long tokens: what follows `serviceKey=` and the like, and the given secrets."""
    for s in filter(None, secrets):
        message = message.replace(s, "***")
    return re.sub(r"(?i)((?:service|api|access)_?(?:key|token)=)[^&\s\"'<>]+", r"\1***", message)


class PagedReader(DataSourceReader):
    """One partition per request; pages of `rows` items are fetched until the total is reached or a page is empty.

    More items than max_pages hold are an error, never cut off. A failing page is tried again, up to `failures` times in
    a row; then the request fails (the breaker), with a message without keys.
    """

    def __init__(self, fetch: Callable[[dict, int], dict], requests: list[dict], max_pages: int, failures: int, rows: int = PAGE_ROWS):
        self.fetch, self.requests, self.max_pages, self.failures, self.rows = fetch, requests, max_pages, failures, rows

    def partitions(self):
        return [PagedRequest(r) for r in self.requests]

    def page(self, request: dict, page: int) -> dict:
        said = []
        for _ in range(self.failures):
            try:
                return self.fetch(request, page)
            except Exception as e:  # noqa: BLE001  fetch is foreign code
                said.append(scrubbed(str(e), [str(v) for k, v in request.items() if "key" in k.lower()]))
        raise Unavailable(f"page {page} failed {self.failures} times: {said[-1]}")

    def read(self, partition):
        key = json.dumps(partition.request, sort_keys=True, ensure_ascii=False)
        seen = 0
        for page in range(1, self.max_pages + 1):
            got = self.page(partition.request, page)
            items = items_of(got)
            seen += len(items)
            for item in items:
                yield key, page, json.dumps(item, ensure_ascii=False, sort_keys=True)
            if not items or page * self.rows >= (got.get("total") or 0):
                return
        raise Truncated(f"{key}: {got.get('total')} items, of which {self.max_pages} pages hold {seen}")


def paged(spark: SparkSession, fetch: Callable[[dict, int], dict], requests: list[dict], max_pages: int = MAX_PAGES, failures: int = 1, rows: int = PAGE_ROWS) -> DataFrame:
    """request, page, item (JSON) of every request; fetch(request, page) returns {"items": [...], "total": n}.

    With max_pages 1 it is a single-shot source: an answer that does not hold all its items is an error.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return "cairn_paged"

        def schema(self):
            return "request string, page int, item string"

        def reader(self, schema):
            return PagedReader(fetch, requests, max_pages, failures, rows)

    spark.dataSource.register(Paged)
    return spark.read.format("cairn_paged").load()


def pages_needed(total, rows: int = PAGE_ROWS) -> F.Column:
    """Calls that a request of so many items takes."""
    return F.greatest(F.lit(1), F.ceil(total / rows))


def planned_calls(left: DataFrame, right: DataFrame, cached: DataFrame, on: list[str]) -> DataFrame:
    """Requests of all combinations of two short lists that the cache does not hold."""
    return paired(left, right).join(cached.select(*on).distinct(), on, "left_anti")


def write_cache(responses: DataFrame, path: str) -> int:
    """Append the responses (request, page, item) of requests that the cache does not hold yet; how many rows came."""
    return append_new(responses, path, "request")


def search_steps(places: DataFrame, searched: DataFrame, found: DataFrame, budget: int) -> DataFrame:
    """The next step of every place of a search for it: `fetch` where a search has a match, `search` where none was made
    (the first by place_id that the budget of calls allows; the rest `wait`), `done` where it had none."""
    matched = found.groupBy("place_id").agg(F.min_by("found_id", F.struct("km", "found_id")).alias("found_id"))
    known = places.select("place_id").join(searched.select("place_id").distinct().withColumn("_s", F.lit(True)), "place_id", "left").join(matched, "place_id", "left")
    new = within_budget(known.where("_s is null"), ["place_id"], budget).select("place_id").withColumn("_now", F.lit(True))
    step = F.when(F.col("found_id").isNotNull(), "fetch").when(F.col("_s"), "done").when(F.col("_now"), "search").otherwise("wait")
    return known.join(new, "place_id", "left").select("place_id", "found_id", step.alias("step"))


def within_budget(requests: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The first requests of an order that a budget of calls allows."""
    return requests.orderBy(*order).limit(budget)


CALLS, FAILURES = 900, 3


def guarded(requests: DataFrame, call: Callable[[dict], str], source: str, order: list[str], state: DataFrame | None = None, budget: int = CALLS, failures: int = FAILURES) -> tuple[DataFrame, DataFrame]:
    """(requests with status, answer and error; the state of every source after them).

    The calls of a source go one after the other, in their order, and stop for good when its budget is spent or `failures`
    calls in a row have failed, whichever partitions its requests came from: its first `budget` requests are one group, so
    a group is bounded, and the rest is stopped without being gathered. Sources run side by side. state (source, calls, run)
    holds what earlier runs spent and their last run of failures. status is ok, failed or stopped; an order tells requests
    apart. The answer is text; call gets the request as a dict.
    """
    number = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    none = requests.sparkSession.createDataFrame([], f"{source} {requests.schema[source].dataType.simpleString()}, calls long, run long")
    before = (none if state is None else state.select(source, "calls", "run")).withColumnsRenamed({"calls": "_calls", "run": "_run"})
    first = requests.withColumn("_i", number).where(F.col("_i") <= budget).join(before, source, "left").na.fill(0, ["_calls", "_run"])
    names = requests.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_i")
        calls, failed, out = int(group["_calls"].iloc[0]), int(group["_run"].iloc[0]), []
        for request in group[names].to_dict("records"):
            if calls >= budget or failed >= failures:
                out.append(("stopped", None, f"budget of {budget} calls" if calls >= budget else f"{failures} failures in a row"))
                continue
            calls += 1
            try:
                out.append(("ok", call(request), None))
                failed = 0
            except Exception as e:  # noqa: BLE001  call is foreign code
                out.append(("failed", None, scrubbed(str(e), [str(v) for k, v in request.items() if "key" in k.lower()])))
                failed += 1
        return group.drop(columns=["_calls", "_run"]).assign(status=[o[0] for o in out], answer=[o[1] for o in out], error=[o[2] for o in out], calls=calls, run=failed)

    tried = first.groupBy(source).applyInPandas(run, f"{kind}, _i int, status string, answer string, error string, calls long, run long")
    tried = materialize(tried, "calls")  # calls are made once, whatever reads the result
    after = tried.groupBy(source).agg(F.max("calls").alias("calls"), F.max("run").alias("run"))
    reason = F.when(F.col("calls") >= budget, F.lit(f"budget of {budget} calls")).otherwise(F.lit(f"{failures} failures in a row"))
    rest = requests.withColumn("_i", number).where(F.col("_i") > budget).join(after, source).select(*names, F.lit("stopped").alias("status"), F.lit(None).cast("string").alias("answer"), reason.alias("error"))
    kept = after if state is None else after.unionByName(state.select(source, "calls", "run").join(after, source, "left_anti"))
    return tried.select(*names, "status", "answer", "error").unionByName(rest), kept


def with_details(rows: DataFrame, key: str, fetch: Callable[[list], dict], cache: str, kind: str, batch: int = 100) -> DataFrame:
    """rows with `detail`, what a lookup says for their key, as text; null where it has nothing for it, or the key is null.

    Distinct keys that the cache (a Parquet folder of key and detail) does not hold are fetched, `batch` at a time in each
    partition, and appended to it, with a null detail where there is none; so a key is looked up once, and a run that was
    cut off goes on where it stopped. kind is the SQL type of the key.
    """
    spark = rows.sparkSession
    keys = rows.select(F.col(key).cast(kind).alias("key")).where("key is not null").distinct()
    missing = keys.join(spark.read.parquet(cache).select("key"), "key", "left_anti") if exists(spark, cache) else keys

    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            wanted = pdf["key"].tolist()
            for lo in range(0, len(wanted), batch):
                some = wanted[lo : lo + batch]
                got = fetch(some)
                yield pd.DataFrame({"key": some, "detail": [got.get(k) for k in some]})

    missing.mapInPandas(run, f"key {kind}, detail string").write.mode("append").parquet(cache)
    return rows.join(spark.read.parquet(cache).withColumnRenamed("key", "_key"), F.col(key).cast(kind) == F.col("_key"), "left").drop("_key")
