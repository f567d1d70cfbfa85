"""Operator 5, Jaccard join of documents' sets of five-word shingles (75 % or more), and its connected groups.

1. Every whole text becomes a set of 64-bit shingle hashes; equal sets collapse to one class.
2. Candidates, without loss: put all shingles in one order; of two sets that link, each has its first common shingle
   among the first n - ceil(0.75 n) + 1 of its own (the prefix principle). The order is: shingles that a sample finds
   frequent come last, then the lower half of the hash range comes before the upper, then the rarer ones before the more
   frequent. So a set need send only its lower half, mostly, to be counted, and a shingle that only one set sends
   fills a place of the prefix without leading anywhere: sets with enough text of their own have no candidate at all,
   whatever passages they share with others. Index lists hold the prefixes, in bands of set size; only neighbouring
   bands can link, and what leaves a list is a star to its least set, first of what a task holds, then of all.
3. The stars' connected groups are joined exactly, each in one task, or block against block where a group is large:
   inverted lists of its shingles, ordered by set size, give a set's overlap with all others; lists are entered at the
   position of the first set large enough and left at the last one small enough. For a set much like the one before it
   the overlaps are not counted again but derived: the lists of shingles that it lacks are subtracted, those that it
   has more added (set-relation skipping after Wang et al., 2017).

Edge cases: null text counts as empty; a text without words has no shingle, links with nothing and is its own
component; fewer than five words are one shingle; equal texts share a class; repeated rows are kept; a null doc_id
links as any other but never names a component, unless no other does (then null); further columns are ignored.
Very long texts are shingled whole; ties of the least doc_id are rows of one id, which share their component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.memory import tidied
from cairn.operators.components import components
from cairn.session import discard, materialize

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
#: The sample whose frequent shingles (of FREQUENT different sets in it) come last in the order, and a bound of their number.
#: They are a matter of speed: any order gives the same links.
SAMPLE_DOCS, FREQUENT, MAX_FREQUENT = 5_000, 3, 200_000
#: Shingles that one task counts at a time, and that it gathers before it sends them; more parts than MAX_PARTS share tasks.
PART_TOKENS, FLUSH_TOKENS, MAX_PARTS = 1_000_000, 500_000, 32_768
#: Sizes of sets in one band differ by less than this factor; it is a little above 1 / 0.75, so that linked sets are in the same band or the next.
BAND = 1.34
#: Shingles of a group that one task holds at a time; larger groups are joined block by block, and those above the second
#: number in as many blocks as the root of what they hold of it.
GROUP_BLOCK, ROOT_BLOCK = 1_500_000, 50_000
#: Keys that a task keeps to leave out copies of what it has sent; copies that still come are left out later.
SEEN_KEYS = 300_000
#: Rows up to which a table of ids is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TURN = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(raw, dtype=np.uint8)
    word = np.concatenate([[False], ~_IS_SPACE[b], [False]])
    turns = np.flatnonzero(word[1:] != word[:-1])
    start, stop = turns[::2], turns[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(len(b) + 1)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
    h = _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))
    if len(h) < SHINGLE:
        return _mix(np.array([sum(int(x) * int(t) for x, t in zip(h, _TURN)) + len(h) & (1 << 64) - 1], dtype=np.uint64))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _TURN[0]
    for k in range(1, SHINGLE):
        s = s + h[k : k + n] * _TURN[k]
    return np.unique(_mix(s))


def key_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def class_of(key: bytes) -> int:
    """A short name of the key, for what is sent per shingle; two keys of one name would only be candidates of each other."""
    return int.from_bytes(key[:8], "little", signed=True)


def prefix_length(n):
    """How many of a set's first shingles hold one of any linked set's first ones."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(BAND)).astype(np.int32)


REF = "coalesce(doc_id, xxhash64(text))"


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Shingles that FREQUENT sets of a sample have, in order; the sample is picked by a hash of the text."""
    step = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(step)) == 0).select("text")

    def run(it: Iterator[pa.RecordBatch]):
        seen: set[bytes] = set()
        for b in it:
            sets = {key_of(s): s for s in map(shingle_set, b.column("text").to_pylist()) if len(s)}
            new = [k for k in sets if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([sets[k].astype(np.int64) for k in new], pa.list_(pa.int64()))], names=["key", "tokens"])

    found = some.mapInArrow(tidied(run), "key binary, tokens array<long>").dropDuplicates(["key"]).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    rows = found.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).collect()
    return np.sort(np.array([r.token for r in rows], dtype=np.int64))


def _is_in(tokens: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the tokens (as signed numbers) are among some, which is in order."""
    if not len(some):
        return np.zeros(len(tokens), dtype=bool)
    return some[np.minimum(np.searchsorted(some, tokens), len(some) - 1)] == tokens


def sent_tokens(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of a set (sorted hashes): the shingles to be counted, those of the frequent ones that are in its prefix, and how many
    rare ones it has in the lower and in the upper half."""
    signed = tokens.astype(np.int64)  # the upper half is negative
    often = _is_in(signed, frequent)
    rare, p = signed[~often], prefix_length(len(tokens))
    low = int((rare >= 0).sum())
    return rare[:low] if low >= p else rare, np.sort(signed[often])[: max(0, p - len(rare))], low, len(rare) - low


def describe(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, ref and th (they find the row again), n, key of the set (null if empty), cls, and its rare shingles by half."""

    def run(it: Iterator[pa.RecordBatch]):
        for b in it:
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            keys = [key_of(s) if len(s) else None for s in sets]
            halves = [sent_tokens(s, frequent)[2:] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("ref"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([None if k is None else class_of(k) for k in keys], pa.int64()), pa.array([x for x, _ in halves], pa.int64()), pa.array([x for _, x in halves], pa.int64())],
                names=["doc_id", "ref", "th", "n", "key", "cls", "low", "high"],
            )

    return docs.select("doc_id", "text", F.expr(REF).alias("ref"), F.xxhash64("text").alias("th")).mapInArrow(tidied(run), "doc_id long, ref long, th long, n long, key binary, cls long, low long, high long")


def _packed(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each part, with the bytes of its entries of every column."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    pieces = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]))
    return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), *(pa.array([c[order][a:b].tobytes() for a, b in pieces], pa.binary()) for c in columns.values())], names=["part", *columns])


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    """rows with a part each to one task, parts one after the other; a task has several where there are more than MAX_PARTS."""
    tasks = min(parts, MAX_PARTS)
    return rows.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part")


def _parts(it: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """The values of the columns of every part, from rows in the order of parts."""
    current, held = None, [[] for _ in columns]
    for b in it:
        for part, *values in zip(*(b.column(c).to_pylist() for c in ("part", *columns))):
            if part != current and held[0]:
                yield held
                held = [[] for _ in columns]
            current = part
            for h, v in zip(held, values):
                h.append(v)
    if held[0]:
        yield held


def _entries(rows: list[bytes | None], kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in rows if x), dtype=kind)


def shared_tokens(docs: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """part, owners, tokens, dfs: packed entries, by a part of the classes: of every class those of its sent shingles that
    another class sends too, and how many do; frequent ones have FAR for that."""

    def send(it: Iterator[pa.RecordBatch]):
        seen: set[bytes] = set()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            owner = lambda k: np.repeat(np.array([c for c, *_ in held], dtype=np.int64), [len(x[k]) for x in held])
            rare, often = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            tokens, owners = np.concatenate([rare, often]), np.concatenate([owner(1), owner(2)])
            where = np.concatenate([rare >> 20, owner(2)])  # frequent ones go by class: no task gets all of one
            return _packed((where % parts).astype(np.int32), {"tokens": tokens, "owners": owners, "often": np.arange(len(tokens)) >= len(rare)})

        for b in it:
            for s in map(shingle_set, b.column("text").to_pylist()):
                if not len(s) or (key := key_of(s)) in seen:
                    continue
                if len(seen) >= SEEN_KEYS:
                    seen.clear()
                seen.add(key)
                rare, often, *_ = sent_tokens(s, frequent)
                held.append((class_of(key), rare, often))
                size += len(rare) + len(often)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(it: Iterator[pa.RecordBatch]):
        for tokens, owners, often in _parts(it, ["tokens", "owners", "often"]):
            tokens, owners, often = _entries(tokens), _entries(owners), _entries(often, bool)
            order = np.lexsort((owners, tokens))
            tokens, owners, often = tokens[order], owners[order], often[order]
            new = np.ones(len(tokens), dtype=bool)  # copies of a class from several tasks go
            new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
            tokens, owners, often = tokens[new], owners[new], often[new]
            first = np.ones(len(tokens), dtype=bool)
            first[1:] = tokens[1:] != tokens[:-1]
            runs = np.diff(np.flatnonzero(first), append=len(tokens))
            dfs = np.where(often, FAR, np.repeat(runs, runs))
            keep = dfs > 1
            yield _packed((owners[keep] % parts).astype(np.int32), {"owners": owners[keep], "tokens": tokens[keep], "dfs": dfs[keep].astype(np.int32)})

    sent = docs.select("text").mapInArrow(tidied(send), "part int, tokens binary, owners binary, often binary")
    return _by_part(sent, parts).mapInArrow(tidied(count), "part int, owners binary, tokens binary, dfs binary")


#: Stands for the count of a frequent shingle.
FAR = 2_147_483_647


def prefix_of(tokens: np.ndarray, dfs: np.ndarray, n: int, low: int, high: int) -> np.ndarray:
    """Those of a class's shared shingles that are in its prefix; the ones that it shares with no other come before them."""
    p, out = prefix_length(n), []
    for part, size in (((dfs < FAR) & (tokens >= 0), low), ((dfs < FAR) & (tokens < 0), high)):
        if p <= 0:
            break
        some = np.flatnonzero(part)
        first = some[np.lexsort((tokens[some], dfs[some]))]
        out.append(tokens[first[: max(0, min(p, size) - (size - len(some)))]])
        p -= size
    if p > 0:
        out.append(np.sort(tokens[dfs == FAR])[:p])
    return np.concatenate(out) if out else tokens[:0]


def stars(tokens: np.ndarray, bands: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of index entries: distinct edges (class, least class of its list), and the lists (token, band, least class)."""
    order = np.lexsort((owners, bands, tokens))
    tokens, bands, owners = tokens[order], bands[order], owners[order]
    first = np.ones(len(tokens), dtype=bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (bands[1:] != bands[:-1])
    head = np.repeat(owners[first], np.diff(np.flatnonzero(first), append=len(tokens)))
    edges = np.unique(np.stack([owners, head])[:, owners != head], axis=1)
    return edges[0], edges[1], tokens[first], bands[first], owners[first]


def candidates_of(shared: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """node, component: the connected groups of all classes that may link."""
    none = F.lit(None)
    facts = classes.select(F.pmod("cls", F.lit(parts)).cast("int").alias("part"), *[none.cast("binary").alias(c) for c in ("owners", "tokens", "dfs")], "cls", "n", "low", "high")
    rows = _by_part(shared.select("*", *[none.cast("long").alias(c) for c in ("cls", "n", "low", "high")]).unionByName(facts), parts)

    def run(it: Iterator[pa.RecordBatch]):
        for owners, tokens, dfs, *facts in _parts(it, ["owners", "tokens", "dfs", "cls", "n", "low", "high"]):
            known = {c: (n, low, high) for c, n, low, high in zip(*facts) if c is not None}
            owners, tokens, dfs = _entries(owners), _entries(tokens), _entries(dfs, np.int32)
            order = np.argsort(owners, kind="stable")
            owners, tokens, dfs = owners[order], tokens[order], dfs[order]
            cuts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else np.zeros(0, dtype=np.int64)
            held = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owners)]):
                cls = int(owners[a])
                n, low, high = known[cls]
                kept = prefix_of(tokens[a:b], dfs[a:b], n, low, high)
                if len(kept):
                    held.append((kept, n, cls))
            if not held:
                continue
            length = [len(x) for x, *_ in held]
            bands = np.repeat(band_of(np.array([n for _, n, _ in held])), length)
            a, b, token, band, least = stars(np.concatenate([x for x, *_ in held]), bands, np.repeat(np.array([c for *_, c in held], dtype=np.int64), length))
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none.cast(pa.int32())], names=["a", "b", "token", "band"])
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.nulls(len(least), pa.int64()), pa.array(token), pa.array(band, pa.int32())], names=["a", "b", "token", "band"])

    found = materialize(rows.mapInArrow(tidied(run), "a long, b long, token long, band int"), "stars")
    heads = found.where("token is not null").select("a", "token", "band")  # one row a list and part
    least = heads.groupBy("token", "band").agg(F.min("a").alias("b"))
    above = least.select("token", (F.col("band") - 1).alias("band"), F.col("b").alias("a"))
    edges = [found.where("token is null").select("a", "b"), heads.join(least, ["token", "band"]).select("a", "b"), least.join(above, ["token", "band"]).select("a", "b")]
    out = components(edges[0].unionByName(edges[1]).unionByName(edges[2]), "a", "b")
    discard(found)
    return out


class Grouping:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def exact_links(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(x, the later sets that link with x), for sets in ascending order of size, x from the largest down.

    Overlaps come from inverted lists; those of a set much like the one before it are derived from that one's.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    count = len(sets)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.split(flat, np.cumsum(sizes)[:-1])
    index = np.sort(flat * count + np.repeat(np.arange(count), sizes))  # lists one after the other, each in order of set size
    posting = index % count

    def of_lists(lists: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How often each of the sets lo to hi is in the lists; each list is entered at lo and left at hi."""
        first = np.searchsorted(index, lists * count + lo)
        lengths = np.searchsorted(index, lists * count + hi) - first
        places = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(posting[places] - lo, minlength=hi - lo)

    before, overlap = None, None  # the set treated last, and its overlaps with the sets from itself on
    for x in range(count - 1, -1, -1):
        lo = x
        hi = int(np.searchsorted(sizes, sizes[x] * DENOMINATOR // NUMERATOR, side="right"))
        derived = False
        if before is not None and 4 * abs(sizes[before] - sizes[x]) < sizes[x]:
            came = np.setdiff1d(at[x], at[before], assume_unique=True)
            if derived := 3 * len(came) < sizes[x]:
                gone = np.setdiff1d(at[before], at[x], assume_unique=True)
                overlap = np.concatenate([[0], overlap[: hi - lo - 1]]) + of_lists(came, lo, hi) - of_lists(gone, lo, hi)
                overlap[0] = sizes[x]
        if not derived:
            overlap = of_lists(at[x], lo, hi)
        before = x
        both = overlap[1:]
        linked = both * DENOMINATOR >= NUMERATOR * (sizes[x] + sizes[lo + 1 : hi] - both)
        yield x, lo + 1 + np.flatnonzero(linked)


def links_in_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, n_links: a spanning forest of the exact links of each group, with the number of links of class a in a row (a, a)."""
    spark = docs.sparkSession
    sums = groups.groupBy("gid").agg(F.sum("n").alias("total")).withColumn("blocks", F.greatest(F.ceil(F.col("total") / GROUP_BLOCK), F.ceil(F.sqrt(F.col("total") / ROOT_BLOCK))).cast("int"))
    members = groups.join(sums, "gid").select("ref", "key", "gid", "blocks")
    side = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    rows = docs.select(F.expr(REF).alias("ref"), "text").join(side, "ref")

    def sets(it: Iterator[pa.RecordBatch]):
        for b in it:
            keep, packed = [], []
            for i, (t, key) in enumerate(zip(b.column("text").to_pylist(), b.column("key").to_pylist())):
                s = shingle_set(t)
                if key_of(s) == key:
                    keep.append(i)
                    packed.append(s.tobytes())
            out = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column("gid"), out.column("blocks"), out.column("key"), pa.array(packed, pa.binary())], names=["gid", "blocks", "key", "tokens"])

    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = (
        rows.mapInArrow(tidied(sets), "gid long, blocks int, key binary, tokens binary").withColumn("own", own).withColumn("p", F.explode(pairs))
        .select("gid", "p.i", "p.j", "own", "key", "tokens")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "gid", "i", "j").sortWithinPartitions("gid", "i", "j", "key")

    def join(it: Iterator[pa.RecordBatch]):
        current, held = None, {}

        def finish():
            rows = sorted(held.items(), key=lambda e: (len(e[1][1]), e[0]))
            keys, block, packed = [k for k, _ in rows], [v[0] for _, v in rows], [v[1] for _, v in rows]
            group, a, b, counts = Grouping(len(rows)), [], [], np.zeros(len(rows), dtype=np.int64)
            cross = current[1] != current[2]
            block = np.array(block)
            for x, linked in exact_links([np.frombuffer(p, dtype=np.uint64) for p in packed]):
                if cross:  # pairs within a block are another task's
                    linked = linked[block[linked] != block[x]]
                counts[x] += len(linked)
                counts[linked] += 1
                for y in linked.tolist():
                    if group.join(x, y):
                        a.append(keys[x])
                        b.append(keys[y])
            some = np.flatnonzero(counts).tolist()
            a += [keys[x] for x in some]
            b += [keys[x] for x in some]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array([0] * (len(a) - len(some)) + counts[some].tolist(), pa.int64())], names=["a", "b", "n_links"])

        for batch in it:
            for gid, i, j, own, key, tokens in zip(*(batch.column(c).to_pylist() for c in ("gid", "i", "j", "own", "key", "tokens"))):
                if (gid, i, j) != current:
                    if len(held) > 1:
                        yield finish()
                    current, held = (gid, i, j), {}
                held[key] = (own, tokens)
        if len(held) > 1:
            yield finish()

    return sorted_.mapInArrow(tidied(join), "a binary, b binary, n_links long")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (classes of other sets that the document links with), ref and th of the
    row, first (whether it is the component's row to keep; equal rows all say so)."""
    docs = docs.select("doc_id", "text")
    frequent = frequent_tokens(docs)
    described = materialize(describe(docs, frequent), "sets")
    filled = described.where("key is not null")
    facts = [F.first(c).alias(c) for c in ("n", "cls", "low", "high")]  # the same in all rows of a key
    classes = materialize(filled.groupBy("key").agg(*facts, F.min("ref").alias("ref"), F.min("doc_id").alias("least"), F.min(F.struct("ref", "th")).alias("row")), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total * 0.6) // PART_TOKENS))
    candidates = candidates_of(shared_tokens(docs, frequent, parts), classes, parts)
    groups = candidates.withColumnRenamed("node", "cls").withColumnRenamed("component", "gid").join(classes.select("cls", "key", "ref", "n"), "cls")
    links = materialize(links_in_groups(docs, groups), "links")
    joined = components(links.where("a <> b"), "a", "b").withColumnRenamed("node", "key")
    counts = links.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("n_links"))
    named = classes.select("key", "least", "row").join(joined, "key", "left").join(counts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"), F.min("row").alias("kept"))
    of_class = named.join(names, "component").select("key", "component_id", "kept", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return described.join(of_class, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "ref", "th",
        (F.col("key").isNull() | (F.col("kept") == F.struct("ref", "th"))).alias("first"),
    )


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n, g, md5(array_to_string(list_sort(g), chr(10))) AS k FROM s),
cls AS (SELECT k, any_value(n) AS n, any_value(g) AS g, min(doc_id) AS least FROM n WHERE n > 0 GROUP BY k),
t AS (SELECT k, n, unnest(g) AS sh FROM cls),
p AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.sh = b.sh AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT k AS a, k AS b FROM cls UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT r.a AS k, min(c.least) AS component_id FROM reach r JOIN cls c ON c.k = r.b GROUP BY 1),
links AS (SELECT a AS k, count(*) AS n_links FROM e GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, CASE WHEN n.n = 0 THEN n.doc_id ELSE component_id END AS component_id, coalesce(n_links, 0) AS n_links FROM n LEFT JOIN comp USING (k) LEFT JOIN links USING (k)
"""
