"""Operator 2, URL filters by a temporal list join, in DataFrame functions only.

Dated list events (add, remove) become validity intervals [valid_from, valid_to) per list, kind and key. Each capture
(url, time of fetch) is looked up under all its keys: its host, the suffixes of its host (domain entries), and its host
with every directory of its path; entries active at the time of the fetch count. The most specific active entry decides
(path over host over domain, then the longer key, then allow over block, then key and start).

The lookup is an as-of join of what differs: every key and time that captures have, once, is merged with the starts of
the key's intervals in order of time, and takes the last start before it, active unless its end has come. The merge runs
within spans of SPAN_DAYS; an interval that goes on is entered at the beginning of each span in which its key is asked
for. So neither a host with a third of all captures nor a key with many intervals multiplies rows or fills one task.
What was found goes back to the captures by key and time. Equal captures are looked up once and spelled out again in the
end. Sides are broadcast only up to BROADCAST_ROWS rows; beyond, keys of more than HOT_ROWS rows, which are few, are
broadcast and the rest is shuffled.

Edge cases: a url that is null or has no host, or a capture without a time, matches nothing and is not blocked; events
without list, kind, key, action or time are left out; on one day, remove comes after add; repeated events count once; an
empty list blocks nothing; an empty table of captures gives no row; further columns of captures are not kept.
Urls of any length are parsed whole; captures that tie in host and time each get the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS, HOT_ROWS = 100_000, 1_000_000
SPAN_DAYS = 32
KINDS = ("domain", "host", "path")  # by rising specificity


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def keys_of(url: Column) -> Column:
    """array<struct<kind, key>> under which entries for the url may be listed; empty without a host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("key")))
    parts = F.split(F.regexp_extract(F.trim(url), r"^[^:]*://[^/?#]*(/[^?#]*)", 1), "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.lit("path").alias("kind"), F.concat(host, F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")).alias("key")))).otherwise(
        F.array().cast("array<struct<kind:string,key:string>>")
    )
    whole = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key")))
    return F.when(host.isNull(), F.array().cast("array<struct<kind:string,key:string>>")).otherwise(F.array_distinct(F.concat(whole, suffixes, folders)))


def intervals(events: DataFrame) -> DataFrame:
    """list, kind, key, valid_from, valid_to (null while it lasts) from events (list, kind, key, action, day)."""
    events = events.select("list", "kind", "key", "action", "day").dropna().distinct()
    w = Window.partitionBy("list", "kind", "key").orderBy("day", "action")
    changes = events.withColumn("before", F.lag("action").over(w)).where(F.col("action") != F.coalesce("before", F.lit("remove")))
    spans = changes.withColumn("valid_to", F.lead("day").over(w)).where("action = 'add' AND (valid_to IS NULL OR valid_to > day)")
    return spans.select("list", "kind", "key", F.col("day").alias("valid_from"), "valid_to")


def span_of(day: Column) -> Column:
    return F.floor(F.unix_date(day.cast("date")) / SPAN_DAYS).cast("int")


def _met(many: DataFrame, few: DataFrame, on: list[str], how: str) -> DataFrame:
    """many joined with few, of which a key has few rows: no task gets all rows of a frequent key of many."""
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), on, how)
    hot = F.broadcast(many.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(*on))  # the rows of many over HOT_ROWS at most
    often = many.join(hot, on, "left_semi").join(F.broadcast(few.join(hot, on, "left_semi")), on, how)
    return often.unionByName(many.join(hot, on, "left_anti").join(few, on, how))


def active_entries(times: DataFrame, listed: DataFrame) -> DataFrame:
    """kind, key, fetched, list, since: for distinct keys and times the interval of each list that is active then, as of that time."""
    key = ["kind", "key", "span"]
    times = times.withColumn("span", span_of(F.col("fetched")))
    first = F.date_from_unix_date(F.col("span") * SPAN_DAYS)
    asked = times.select(*key).distinct()
    here = (F.col("valid_from") < F.date_add(first, SPAN_DAYS)) & (F.col("valid_to").isNull() | (F.col("valid_to") > first))
    none = F.lit(None)
    starts = _met(asked, listed, ["kind", "key"], "inner").where(here).select("list", *key, F.greatest("valid_from", first).alias("at"), F.lit(0).alias("late"), F.struct("valid_from", "valid_to").alias("s"), none.cast(times.schema["fetched"].dataType).alias("fetched"))
    kind = starts.schema["s"].dataType
    points = _met(times, starts.select("list", *key).distinct(), key, "inner").select("list", *key, F.col("fetched").alias("at"), F.lit(1).alias("late"), none.cast(kind).alias("s"), "fetched")
    w = Window.partitionBy("list", *key).orderBy("at", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.unionByName(points).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("late = 1")
    return found.where("s.valid_from <= fetched AND (s.valid_to IS NULL OR fetched < s.valid_to)").select("kind", "key", "fetched", "list", F.col("s.valid_from").alias("since"))


def filter_urls(captures: DataFrame, events: DataFrame) -> DataFrame:
    """page_id, url, fetched, blocked, n_active, rule, active_since for every row of captures (page_id, url, fetched)."""
    listed = intervals(events)
    row = ["page_id", "url", "fetched"]
    once = captures.select(*row).groupBy(*row).agg(F.count(F.lit(1)).alias("copies"))
    keyed = once.withColumn("k", F.explode_outer(keys_of(F.col("url")))).select(*row, "copies", "k.kind", "k.key")
    active = active_entries(keyed.where("kind IS NOT NULL AND fetched IS NOT NULL").select("kind", "key", "fetched").distinct(), listed)
    met = _met(keyed, active, ["kind", "key", "fetched"], "left")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.when(F.col("list").isNotNull(), F.struct(rank.alias("rank"), F.length("key").alias("len"), (F.col("list") == "allow").cast("int").alias("allow"), F.col("key").alias("key"), F.col("since").alias("since"), F.col("kind").alias("kind")))
    decided = met.groupBy(*row).agg(F.first("copies").alias("copies"), F.count(entry).alias("n_active"), F.max(entry).alias("top"))
    return decided.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *row, F.coalesce(F.col("top.allow") == 0, F.lit(False)).alias("blocked"), "n_active", F.concat("top.kind", F.lit(":"), "top.key").alias("rule"), F.col("top.since").alias("active_since"),
    )


def _number(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 4), 16, 10).cast("int")


def sample_events(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of pages: a function of the host names alone, the same on every table."""
    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h is not null").distinct().withColumn("x", _number(F.col("h")))
    d0 = F.lit("2024-01-01").cast("date")
    event = lambda name, kind, key, action, day: F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"), F.date_add(d0, day.cast("int")).alias("day"))
    h, x = F.col("h"), F.col("x")
    site = F.substring_index(h, ".", -3)
    y = _number(site)
    made = F.array(
        F.when(x % 3 == 0, event("block", "host", h, "add", x % 200)),
        F.when(x % 3 == 0, event("block", "host", h, "remove", x % 200 + 60)),
        F.when(x % 3 == 0, event("block", "host", h, "add", x % 200 + 150)),
        F.when(x % 5 == 1, event("allow", "path", F.concat(h, F.lit("/en/")), "add", x % 100)),
        F.when(x % 4 == 2, event("block", "path", F.concat(h, F.lit("/de/")), "add", x % 250 + 50)),
        F.when(x % 4 == 2, event("block", "path", F.concat(h, F.lit("/de/")), "remove", x % 250 + 140)),
        F.when(y % 4 == 0, event("block", "domain", site, "add", y % 150 + 100)),
    )
    return hosts.select(F.explode(F.array_compact(made)).alias("e")).select("e.*")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")))
    found = filter_urls(captures, sample_events(pages))
    return found.withColumn("fetched", F.col("fetched").cast("string")).withColumn("active_since", F.col("active_since").cast("string"))


OP2_SQL = r"""
WITH hosts AS (
  SELECT DISTINCT nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS h FROM pages
), numbered AS (
  SELECT h, ('0x' || substr(md5(h), 1, 4))::INT AS x, array_to_string(string_split(h, '.')[-3:], '.') AS site FROM hosts WHERE h IS NOT NULL
), both_ AS (SELECT *, ('0x' || substr(md5(site), 1, 4))::INT AS y FROM numbered
), events AS (
  SELECT 'block' AS list, 'host' AS kind, h AS key, 'add' AS action, x % 200 AS d FROM both_ WHERE x % 3 = 0
  UNION SELECT 'block', 'host', h, 'remove', x % 200 + 60 FROM both_ WHERE x % 3 = 0
  UNION SELECT 'block', 'host', h, 'add', x % 200 + 150 FROM both_ WHERE x % 3 = 0
  UNION SELECT 'allow', 'path', h || '/en/', 'add', x % 100 FROM both_ WHERE x % 5 = 1
  UNION SELECT 'block', 'path', h || '/de/', 'add', x % 250 + 50 FROM both_ WHERE x % 4 = 2
  UNION SELECT 'block', 'path', h || '/de/', 'remove', x % 250 + 140 FROM both_ WHERE x % 4 = 2
  UNION SELECT 'block', 'domain', site, 'add', y % 150 + 100 FROM both_ WHERE y % 4 = 0
), steps AS (
  SELECT *, lag(action) OVER (PARTITION BY list, kind, key ORDER BY d, action) AS before FROM events
), changes AS (
  SELECT *, lead(d) OVER (PARTITION BY list, kind, key ORDER BY d, action) AS d_to FROM steps WHERE action <> coalesce(before, 'remove')
), spans AS (SELECT list, kind, key, d AS d_from, d_to FROM changes WHERE action = 'add'
), captures AS (
  SELECT row_number() OVER () AS id, page_id, url, (page_id * 37) % 366 AS d,
    nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS h,
    string_split(regexp_extract(trim(url), '^[^:]*://[^/?#]*(/[^?#]*)', 1), '/') AS parts
  FROM pages
), keys AS (
  SELECT id, 'host' AS kind, h AS key FROM captures
  UNION SELECT id, 'domain', array_to_string(string_split(h, '.')[i:], '.') FROM captures, unnest(range(1, greatest(len(string_split(h, '.')), 2))) AS t(i)
  UNION SELECT id, 'path', h || array_to_string(parts[1:i], '/') || '/' FROM captures, unnest(range(1, len(parts))) AS t(i)
), met AS (
  SELECT c.id, s.kind, s.key, s.list, s.d_from,
    row_number() OVER (PARTITION BY c.id ORDER BY list_position(['domain', 'host', 'path'], s.kind) DESC, length(s.key) DESC, (s.list = 'allow')::INT DESC, s.key DESC, s.d_from DESC) AS r,
    count(*) OVER (PARTITION BY c.id) AS n
  FROM captures c JOIN keys k ON c.id = k.id JOIN spans s ON s.kind = k.kind AND s.key = k.key AND s.d_from <= c.d AND (s.d_to IS NULL OR c.d < s.d_to)
)
SELECT c.page_id, c.url, CAST(DATE '2024-01-01' + CAST(c.d AS INT) AS VARCHAR) AS fetched, coalesce(m.list = 'block', false) AS blocked, coalesce(m.n, 0) AS n_active,
  m.kind || ':' || m.key AS rule, CAST(DATE '2024-01-01' + CAST(m.d_from AS INT) AS VARCHAR) AS active_since
FROM captures c LEFT JOIN met m ON m.id = c.id AND m.r = 1
"""
