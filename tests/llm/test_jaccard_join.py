import random
import re

import numpy as np
import pytest

from cairn.llm import jaccard_join as J
from cairn.operators import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component and number of linked classes of each row, by all pairs that share a shingle."""
    sets = sorted({shingles(t) for _, t in rows} - {frozenset()}, key=lambda s: (len(s), sorted(s)))
    number = {s: i for i, s in enumerate(sets)}
    lists, group, links = {}, J.Grouping(len(sets)), [0] * len(sets)
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in lists.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            lists[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                group.join(i, j)
                links[i] += 1
                links[j] += 1
    least = {}
    for d, t in rows:
        if (s := shingles(t)) and d is not None:
            c = group.find(number[s])
            least[c] = min(d, least.get(c, d))
    return [(d, len(s := shingles(t)), least.get(group.find(number[s])) if s else d, links[number[s]] if s else 0) for d, t in rows]


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 3, b"k") for d, t in rows], "doc_id long, text string, n int, key binary")
    got = J.jaccard_join(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_shingle_sets_are_those_of_the_words():
    rng = random.Random(5)
    seen = {}
    for _ in range(3000):
        text = "".join(rng.choice("aAbB é\t\n\x0b\x1c\xa0ab ") for _ in range(rng.randrange(40)))
        s = shingles(text)
        got = J.shingle_set(text)
        assert len(got) == len(s)
        assert seen.setdefault(s, got.tobytes()) == got.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_exact_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(20, 290), replace=False), rng.integers(0, 1 << 62, rng.integers(1, 30)).astype(np.uint64)])) for _ in range(150)]
    for i in range(0, 150, 2):
        sets[i] = np.unique(np.concatenate([np.delete(sets[0 if i else 1], [i % 9, (i * 7) % 11]), np.array([i], dtype=np.uint64)]))
    sets.sort(key=len)
    got = {(x, y) for x, linked in J.exact_links(sets) for y in linked.tolist()}
    want = {(x, y) for x in range(150) for y in range(x + 1, 150) if 100 * (o := len(np.intersect1d(sets[x], sets[y]))) >= 75 * (len(sets[x]) + len(sets[y]) - o)}
    assert got == want and len(want) > 500


def test_whole_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()])


def test_prefixes_lose_no_linked_pair():
    """Any two linked sets share a kept shingle, in the same band or the next, whatever counts as frequent."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(-(1 << 63), (1 << 63) - 1, rng.integers(4, 200)).astype(np.int64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, len(pool)), replace=False).astype(np.uint64)) for _ in range(10)]
        sets += [np.unique(np.append(np.delete(s, rng.integers(0, len(s), len(s) // 9)), rng.integers(0, 1 << 62, len(s) // 12).astype(np.uint64))) for s in sets]
        sets = [s for s in sets if len(s)]
        frequent = np.sort(rng.choice(pool, rng.integers(0, len(pool)), replace=False))
        sent = [J.sent_tokens(s, frequent) for s in sets]
        df = {}
        for k, (rare, *_) in enumerate(sent):
            for t in rare.tolist():
                df.setdefault(t, {sets[k].tobytes()}).add(sets[k].tobytes())
        kept = []
        for s, (rare, often, low, high) in zip(sets, sent):
            shared = [(t, len(df[t])) for t in rare.tolist() if len(df[t]) > 1] + [(t, J.FAR) for t in often.tolist()]
            tokens, dfs = (np.array([x[k] for x in shared], dtype=np.int64) for k in (0, 1))
            kept.append(set(J.prefix_of(tokens, dfs, len(s), low, high).tolist()))
            assert len(kept[-1]) <= J.prefix_length(len(s))
        for x in range(len(sets)):
            for y in range(x):
                o = len(np.intersect1d(sets[x], sets[y]))
                if 100 * o >= 75 * (len(sets[x]) + len(sets[y]) - o) and sets[x].tobytes() != sets[y].tobytes():
                    assert kept[x] & kept[y] and abs(int(J.band_of(len(sets[x]))) - int(J.band_of(len(sets[y])))) <= 1
    few = [np.array([3, 4, 5], dtype=np.uint64) << np.uint64(20), np.array([1, 3, 4, 5], dtype=np.uint64) << np.uint64(20)]
    assert set(J.sent_tokens(few[0], np.zeros(0, dtype=np.int64))[0].tolist()) & set(J.sent_tokens(few[1], np.zeros(0, dtype=np.int64))[0].tolist())


def test_stars_connect_what_shares_a_list():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 60
        tokens, bands, owners = rng.integers(0, 12, n), rng.integers(0, 3, n).astype(np.int32), rng.integers(0, 25, n)
        a, b, token, band, least = J.stars(tokens, bands, owners)
        group, plain = J.Grouping(25), J.Grouping(25)
        for x, y in zip(a.tolist(), b.tolist()):
            group.join(x, y)
        for x in range(n):
            for y in range(x):
                if tokens[x] == tokens[y] and bands[x] == bands[y]:
                    plain.join(int(owners[x]), int(owners[y]))
        assert [group.find(x) for x in range(25)] == [plain.find(x) for x in range(25)]
        assert sorted(zip(token.tolist(), band.tolist(), least.tolist())) == sorted((t, d, min(owners[(tokens == t) & (bands == d)].tolist())) for t, d in set(zip(tokens.tolist(), bands.tolist())))


@pytest.mark.parametrize("small", [False, True])
def test_groups_chains_and_common_passages(spark, monkeypatch, small):
    if small:  # many buckets and blocks, copies from several tasks, hubs that are not broadcast
        for name, value in (("GROUP_BLOCK", 60), ("PART_TOKENS", 500), ("FLUSH_TOKENS", 300), ("SEEN_KEYS", 2), ("FREQUENT", 10**6)):
            monkeypatch.setattr(J, name, value)
        for name, value in (("BROADCAST_ROWS", 3), ("HUB", 40)):
            monkeypatch.setattr(components, name, value)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(50))
    rows, n = [], 100
    for _ in range(60):  # strangers that share a passage
        rows.append((n := n + 1, " ".join(word() for _ in range(rng.randrange(10, 60))) + " " + passage))
    base = [word() for _ in range(80)]
    for _ in range(60):  # near copies, some further apart than the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(80)] = word()
        rows.append((n := n + 1, " ".join(w)))
    rows += [(d, t) for d, (_, t) in zip(range(90, 95), rows[70:75])] + [(101, "same id, other text here now")]
    rows += [(1, ""), (2, None), (3, " \n"), (None, rows[65][1]), (None, "only a null id"), (None, None), (5, "Short Text"), (4, "short text"), (6, "x " * 9), (7, "x x x x x")]
    rows += [(8, "long " + " ".join(word() for _ in range(20000))), (9, "a b c d e f g h"), (10, "a b c d e f g")]
    check(spark, rows)
    check(spark, [])
