"""Operator 4, resharding by minimum-cost flow.

Rows live in old shards; every old shard is cut into blocks by a hash of the text, so equal texts share a block. From
the bytes of each old shard and the capacities of the new ones, a minimum-cost flow (cost 0 to stay, 1 a byte to move)
says how many bytes go from where to where; blocks are then dealt to these transfers, largest first, and move whole.

A block of more than LARGE of a shard's capacity is cut finer. Its large texts (there are few: their bytes bound their
number) become units of their own, the rest is cut by another hash of the text, so every group of equal texts still moves
as one. Only a text whose copies in an old shard exceed a whole shard is spread, by a hash of the row's place in the table, so
copies with the same doc_id, or none, are spread like any others. Slots are counted in the written files, so they are
gapless even if the table's rows come in another order when they are placed than when they were measured.
Only shards that give or take rows are rewritten; the others keep their files.

What reaches the driver is one row per block, at most old shards times MAX_BLOCKS, and those of the large blocks' cuts.
The number of blocks grows with the rows, so that slots are numbered within blocks of a few thousand rows; beyond 3e9 rows
(MAX_BLOCKS a shard) the blocks themselves grow.

Law `bytes`: the shards' sizes are near equal, up to about one unit (a unit is about LARGE of a shard at most, but never
less than one group of equal texts, and that never more than a shard; pieces of a text beyond a shard are even but for
chance, and dealt by their measured sizes).

Edge cases: null text has size 1 and the crc of no bytes, and counts as the empty text where groups are concerned; null or
repeated doc_ids are placed like any other; rows that tie in doc_id, text and size share out their slots in any order; very
long texts are one row of their size, alone in a unit if need be; an empty table gives no row; columns named like the
operator's own are replaced by them, others are kept in the files.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import scratch

#: Blocks of an old shard, by its rows, and the bound of the table of blocks on the driver.
LEAST_BLOCKS, MAX_BLOCKS, ROWS_A_BLOCK = 1_024, 65_536, 4_096
#: A block of more than LARGE of a shard's capacity is cut into units of about PART of it.
LARGE, PART = 1 / 16, 1 / 64
AT = "place_in_the_table"
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "block", "part", AT)


@dataclass
class Cuts:
    """How an old shard is cut: blocks by a hash of the text, and what is cut finer."""

    blocks: int
    texts: dict[tuple[int, int, int], int]  # (old shard, block, text hash) of large texts -> pieces by place
    parts: dict[tuple[int, int], int]  # (old shard, block) -> parts by another hash of the text

    def pieces(self, o: int, b: int) -> list[tuple[int, int, int]]:
        """(text hash, number of its first piece, pieces) of a block's large texts; the parts of the rest come before."""
        out, first = [], 1 + self.parts[o, b]
        for (ot, bt, h), n in sorted(self.texts.items()):
            if (ot, bt) == (o, b):
                out.append((h, first, n))
                first += n
        return out


@dataclass
class Plan:
    capacity: list[int]
    flow: np.ndarray  # bytes from old shard to new
    target: dict[tuple[int, int, int], int]  # (old shard, block, part) -> new shard
    cuts: Cuts
    moved: int

    def affected(self) -> list[int]:
        """New shards whose rows are not exactly those of the old shard of that number."""
        came = {n for (o, _, _), n in self.target.items() if o != n}
        left = {o for (o, _, _), n in self.target.items() if o != n}
        return sorted(came | left)


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Bytes for each (supplier, taker): all supply is sent, no capacity exceeded, the cost least.

    Successive shortest paths (Bellman-Ford) on the bipartite graph; its size is that of the shard table.
    """
    s, t = len(supply), len(capacity)
    flow = np.zeros((s, t), dtype=np.int64)
    left, room = np.array(supply, dtype=np.int64), np.array(capacity, dtype=np.int64)
    if left.sum() > room.sum():
        raise ValueError("the new shards can't hold the rows")
    while left.any():
        dist_s, dist_t = np.where(left > 0, 0.0, np.inf), np.full(t, np.inf)
        from_s, from_t = np.full(t, -1), np.full(s, -1)
        for _ in range(s + t):
            through = dist_s[:, None] + cost
            best = through.argmin(axis=0)
            new_t = through[best, np.arange(t)]
            better = new_t < dist_t - 1e-9
            dist_t, from_s = np.where(better, new_t, dist_t), np.where(better, best, from_s)
            back = np.where(flow > 0, dist_t[None, :] - cost, np.inf)
            best_t = back.argmin(axis=1)
            new_s = back[np.arange(s), best_t]
            better_s = new_s < dist_s - 1e-9
            dist_s, from_t = np.where(better_s, new_s, dist_s), np.where(better_s, best_t, from_t)
            if not better.any() and not better_s.any():
                break
        end = int(np.where(room > 0, dist_t, np.inf).argmin())
        path, j = [], end
        while True:
            i = int(from_s[j])
            path.append((i, j, 1))
            if from_t[i] < 0 or left[i] > 0 and dist_s[i] == 0:
                break
            j = int(from_t[i])
            path.append((i, j, -1))
        amount = min([int(left[path[-1][0]]), int(room[end]), *(int(flow[i, j]) for i, j, d in path if d < 0)])
        for i, j, d in path:
            flow[i, j] += d * amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def place_in_blocks(docs: DataFrame, old_shard: Column, cuts: Cuts) -> DataFrame:
    """docs with size, old_shard, block and part: 0 in whole blocks, else a part of the block or a piece of a large text."""
    placed = (
        docs.select(*[c for c in docs.columns if c not in OWN])
        .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
        .withColumn("old_shard", old_shard.cast("int"))
        .withColumn("block", F.pmod(F.shiftrightunsigned(text_hash(), 24), F.lit(cuts.blocks)).cast("int"))
    )
    if cuts.texts:
        placed = placed.withColumn(AT, F.monotonically_increasing_id())
    part = F.lit(0)
    for (o, b), k in sorted(cuts.parts.items()):  # few: each is LARGE of a shard
        inner = F.pmod(F.xxhash64(text_hash()), F.lit(k)) + 1
        for h, first, n in cuts.pieces(o, b):
            inner = F.when(text_hash() == h, F.lit(first) + F.pmod(F.xxhash64(AT), F.lit(n))).otherwise(inner)
        part = F.when((F.col("old_shard") == o) & (F.col("block") == b), inner).otherwise(part)
    return placed.withColumn("part", part.cast("int")).drop(AT)


def _measure(placed: DataFrame) -> list[tuple[int, int, int, int, int]]:
    return [tuple(r) for r in placed.groupBy("old_shard", "block", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("old_shard", "block", "part").collect()]


def blocks_for(rows: int, old_shards: int) -> int:
    blocks = LEAST_BLOCKS
    while blocks < MAX_BLOCKS and rows > blocks * old_shards * ROWS_A_BLOCK:
        blocks *= 2
    return blocks


def plan_transfers(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int) -> Plan:
    """The transfers that make the sizes of the new shards near equal and move the fewest bytes."""
    cuts = Cuts(blocks_for(docs.count(), old_shards), {}, {})
    placed = place_in_blocks(docs, old_shard, cuts)
    rows = _measure(placed)
    total = sum(r[3] for r in rows)
    capacity = [total // new_shards + (i < total % new_shards) for i in range(new_shards)]
    most = max(capacity, default=0)
    piece = max(1, int(most * PART))
    large = {(o, b): size for o, b, _, size, n in rows if size > most * LARGE and n > 1}
    together: dict[tuple[int, int, int], tuple[int, int, int]] = {}  # piece -> first piece of its text, where that moves whole
    if large:
        in_large = F.concat_ws(":", "old_shard", "block").isin([f"{o}:{b}" for o, b in sorted(large)])
        texts = placed.where(in_large).groupBy("old_shard", "block", text_hash().alias("h")).agg(F.sum("size").alias("size")).where(F.col("size") > piece)
        of_text = {(r.old_shard, r.block, r.h): r.size for r in texts.collect()}  # no more than all bytes over a piece's
        for (o, b, h), size in of_text.items():
            cuts.texts[o, b, h] = -(-size // piece)
            large[o, b] -= size
        cuts.parts.update({k: max(1, -(-rest // piece)) for k, rest in large.items()})
        together = {(o, b, first + j): (o, b, first) for o, b in large for h, first, n in cuts.pieces(o, b) if of_text[o, b, h] <= most for j in range(n)}
        rows = _measure(place_in_blocks(docs, old_shard, cuts))
    supply = [sum(r[3] for r in rows if r[0] == o) for o in range(old_shards)]
    cost = np.ones((old_shards, new_shards)) - np.eye(old_shards, new_shards)
    flow = min_cost_flow(supply, capacity, cost)
    weight: dict[tuple[int, int, int], int] = {}  # units, which move whole
    for r in rows:
        u = together.get(r[:3], r[:3])
        weight[u] = weight.get(u, 0) + r[3]
    pieces = {(o, b, first + j) for o, b in large for _, first, n in cuts.pieces(o, b) for j in range(n)}
    for u in pieces:
        weight.setdefault(together.get(u, u), 0)  # one that chance left empty has a place, too
    owed = flow.astype(np.float64)
    goes = {}
    for u in sorted(weight, key=lambda u: (-weight[u], u)):
        goes[u] = int(owed[u[0]].argmax())
        owed[u[0], goes[u]] -= weight[u]
    _even_out(weight, goes, capacity)
    target = {u: goes[together.get(u, u)] for u in {r[:3] for r in rows} | pieces}
    return Plan(capacity, flow, target, cuts, sum(r[3] for r in rows if target[r[:3]] != r[0]))


def _even_out(weight: dict, goes: dict, capacity: list[int]) -> None:
    """Whole blocks leave a round-off: move single blocks, preferring those already in transit, while that evens it."""
    over = [-c for c in capacity]
    held: list[list] = [[] for _ in capacity]
    for u, n in goes.items():
        over[n] += weight[u]
        held[n].append(u)
    for _ in range(64 * len(capacity)):
        a, b = int(np.argmax(over)), int(np.argmin(over))
        want = min(over[a], -over[b])
        fit = [u for u in held[a] if 0 < weight[u] <= want]
        if not fit:
            break
        u = max(fit, key=lambda u: (weight[u] > want / 2 and u[0] != a, weight[u], u))
        held[a].remove(u)
        held[b].append(u)
        goes[u] = b
        over[a] -= weight[u]
        over[b] += weight[u]


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, out: str, in_place: bool = False) -> tuple[DataFrame, Plan]:
    """Write the rows of every affected new shard under `out` (one folder per shard) and return all rows with their place.

    in_place: docs are read from files of the old shards that stay; rows of shards without a transfer are left there and
    read from there.
    """
    spark = docs.sparkSession
    plan = plan_transfers(docs, old_shard, old_shards, new_shards)
    where = spark.createDataFrame([(*k, n) for k, n in plan.target.items()], "old_shard int, block int, part int, shard int")
    placed = place_in_blocks(docs, old_shard, plan.cuts).join(F.broadcast(where), ["old_shard", "block", "part"])  # old shards times MAX_BLOCKS rows and few cuts
    affected = plan.affected() if in_place else list(range(new_shards))
    placed.where(F.col("shard").isin(affected)).write.partitionBy("shard").parquet(out)
    schema = placed.schema
    stored = spark.read.schema(schema).parquet(out)
    if kept := sorted({n for n in plan.target.values()} - set(affected)):
        stored = stored.unionByName(placed.where(F.col("shard").isin(kept)))
    return stored, plan


def with_slots(stored: DataFrame) -> DataFrame:
    """The place of each row in its shard: blocks, parts and pieces one after the other, rows of one by doc_id."""
    unit = ["old_shard", "block", "part"]
    light = stored.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "shard", *unit)
    counts = stored.groupBy("shard", *unit).agg(F.count(F.lit(1)).alias("n"))  # old shards times MAX_BLOCKS rows and few cuts
    before = F.sum("n").over(Window.partitionBy("shard").orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1))
    light = light.join(F.broadcast(counts.select(*unit, F.coalesce(before, F.lit(0)).alias("base"))), unit)
    of_block = Window.partitionBy(*unit).orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return light.withColumn("slot", F.col("base") + F.row_number().over(of_block) - 1)


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, so far in 12 shards by a hash of their text, in 16 of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored, _ = reshard(docs, F.pmod(text_hash(), F.lit(12)), 12, 16, scratch(spark, "shards"))
    return with_slots(stored).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", (F.col("shard") != F.col("old_shard")).alias("moved"),
    )
