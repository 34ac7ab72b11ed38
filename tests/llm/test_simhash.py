import random

import numpy as np
import xxhash

from tidemark.llm import components, simhash


def brute_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                comp[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéöß") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    out = [None, "", "  \n", "one", "One two", "one TWO", "É é x", "a b c", "x " * 5000]
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 250))]
        for copy in range(rng.randrange(1, 5)):
            some = list(base)
            for _ in range(copy):
                some[rng.randrange(len(some))] = rng.choice(words)
            out.append(" ".join(some))
    return out


def test_groups_are_brute_force(spark):
    rows = [(i * 3 % 997, t, 1) for i, t in enumerate(texts())] + [(None, "a b c", 2), (None, "only null here zz yy xx", 3)]
    rows += rows[20:24]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(5)
    fps = [brute_fp(t) for _, t, _ in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, brute_components(fps, [r[0] for r in rows]))), key=str)
    assert sorted(map(tuple, simhash.digest(df).collect()), key=str) == want
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    named = {c for _, _, c in want}
    assert sorted(got, key=str) == sorted(named, key=str)
    assert simhash.digest(df.limit(0)).collect() == []


def test_links_with_split_shards(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    points = [int(b) for b in base]
    for b in base[:6]:
        for _ in range(120):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            points.append(x)
    points = sorted(set(points))
    ids = list(range(len(points)))
    want = brute_components(points, ids)
    signed = np.array(points, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    for hot, shard in ((10, 64), (100_000, 16), (100_000, 512)):
        got = {r.fp: r.component for r in simhash.link(df, hot=hot, shard=shard).collect()}
        parts, expect = {}, {}
        for i, x in enumerate(signed):
            parts.setdefault(got.get(int(x), int(x)), set()).add(i)
            expect.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, expect.values()))


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    points = np.unique(np.concatenate([rng.integers(0, 2**63, 500, dtype=np.uint64), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64))]))
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if bin(int(points[i] ^ points[j])).count("1") <= 3}
    got = set()
    for i, j in simhash.Tree(points, 16).pairs(3):
        got |= set(zip(i.tolist(), j.tolist()))
    assert got == want
    assert len(simhash.forest(np.array([5] * 200, np.uint64), np.zeros(0, np.uint64))[0]) == 199  # equal points
    met = {(i, j) for a, b in simhash.Tree(points, 16).pairs(3, points[::5]) for i, j in zip((a * 5).tolist(), b.tolist())}
    assert met == {p for i, j in want for p in ((i, j), (j, i)) if p[0] % 5 == 0} | {(i, i) for i in range(0, len(points), 5)}


def test_dealing_reaches_over_boundaries():
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 2**32, 4000, dtype=np.uint64))
    tree = simhash.dealer(points, 32)
    place, shard, home = simhash.dealt(tree, points)
    assert sorted(place[home].tolist()) == list(range(len(points)))  # each lives in one shard
    assert len(set(shard.tolist())) == 32 and 1.5 < len(place) / len(points) < 8
    reached = set(zip(place.tolist(), shard.tolist()))
    lives = dict(zip(place[home].tolist(), shard[home].tolist()))
    for bit in range(0, 32, 5):
        near = points ^ np.uint64(1 << bit)
        at, where, own = simhash.dealt(tree, near)
        assert all((p, s) in reached for p, s in zip(at[own].tolist(), where[own].tolist()))
    assert set(lives) == set(range(len(points)))


def test_query_goes_through_the_trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = simhash.fingerprints(docs).select("fp").distinct()
    dealt = simhash.shards(fps).toPandas()
    assert dealt["shard"].nunique() > 2 and not dealt["home"].all() and dealt["home"].sum() == 2 * fps.count()
    splits = [simhash.Tree(x.to_numpy(np.int64).view(np.uint64)).splits for _, x in dealt[dealt["home"]].groupby("shard")["fp"]]
    assert min(splits) > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 203), 200)}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
