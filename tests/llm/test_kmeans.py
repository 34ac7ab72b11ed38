import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import kmeans

SCHEMA = "vec_id long, embedding array<double>, x int, cluster string"


def brute(rows, k, rounds, dimensions, seed=3):
    """The rounds in Python's integers; rows of (vec_id, embedding)."""
    kept = [(i, e) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    vectors = [[math.floor(x * 1024) if math.isfinite(x * 1024) else int(x) * 1024 for x in e] for _, e in kept]
    mark = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    centroids = [vectors[j] for j in sorted(range(len(kept)), key=lambda j: (mark[j], kept[j][1]))[:k]]

    def assign():
        out = []
        for v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for v, (c, _) in zip(vectors, found) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    big = kmeans.LONGEST
    inertia = [sum(d for c, d in found if c == j) for j in range(len(centroids))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, min(d, big), min(inertia[c], big), min(sum(inertia), big), marks[c]) for (i, _), (c, d) in zip(kept, found)]


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def run(spark, rows, k=8, rounds=4, dimensions=8, leading=3):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)
    found = kmeans.clustered(df.repartition(3), k, rounds, leading, dimensions).collect()
    return sorted((tuple(r)[:-1] for r in found), key=key), [r.verified for r in found]


def vectors(n, dimensions=8, seed=1, groups=5, spread=0.1):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(middle)]) for i in range(n)]


def test_equal_to_brute_force(spark):
    rows = vectors(300)
    got, verified = run(spark, rows)
    assert got == sorted(brute(rows, 8, 4, 8), key=key)
    assert sum(verified) / len(verified) < 4  # of eight


@pytest.mark.parametrize("leading", [0, 1, 8])
def test_any_number_of_leading_coordinates(spark, leading):
    rows = vectors(120, seed=2, groups=3, spread=1.0)
    assert run(spark, rows, leading=leading)[0] == sorted(brute(rows, 8, 4, 8), key=key)


def test_odd_rows(spark):
    rows = vectors(60, seed=3)
    rows += [(100, None), (101, []), (102, [1.0] * 7), (103, [1.0] * 9), (104, [None] + [1.0] * 7), (105, [math.nan] * 8), (106, [math.inf] + [0.0] * 7)]
    rows += [(None, [0.5] * 8), (None, [-0.25] * 8), (7, [0.0] * 8), (7, [0.0] * 8), (200, [-0.0] * 8), (201, [-0.0001] * 8)]
    assert run(spark, rows)[0] == sorted(brute(rows, 8, 4, 8), key=key)


def test_ties_and_copies(spark):
    rows = [(i, [0.0] * 8) for i in range(40)] + [(i, [2.0] + [0.0] * 7) for i in range(40, 60)] + [(i, [1.0] + [0.0] * 7) for i in range(60, 65)]
    got, _ = run(spark, rows)
    assert got == sorted(brute(rows, 8, 4, 8), key=key)  # empty clusters stay, equal distances go to the smaller number


def test_few_and_none(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None)])[0] == []
    rows = vectors(3)
    assert run(spark, rows)[0] == sorted(brute(rows, 8, 4, 8), key=key)


def test_large_components(spark):
    rows = vectors(40, seed=5) + [(50, [1e300] + [0.0] * 7), (51, [-1e308] * 8), (52, [1.7e308] * 8), (53, [65535.99] * 8), (54, [65536.0] * 8), (55, [3e9] + [0.5] * 7), (56, [-3e9] + [0.5] * 7)]
    assert run(spark, rows, rounds=3)[0] == sorted(brute(rows, 8, 3, 8), key=key)


def test_bounds_lie_below():
    rng = np.random.default_rng(4)
    for scale in (1, 1000, 1 << 25):
        v = rng.integers(-scale, scale + 1, (500, 16))
        centroids = v[:8].copy()
        axes = np.linalg.qr(rng.normal(size=(16, 16)))[0][:, :5]
        cluster, distance, _ = kmeans.nearest(v, *kmeans._split(v.astype(float), axes), centroids, axes)
        every = ((v[:, None, :].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
        assert (distance == every.min(1)).all() and (cluster == [list(r).index(min(r)) for r in every]).all()


def test_limbs():
    for total in (0, 1, -1, 2**32, -(2**32), 2**63, -(2**63), 2**200 + 12345, -(3**150)):
        assert sum(v << (32 * limb) for limb, v in kmeans._limbs(total)) == total
        assert all(-(2**32) <= v <= 2**32 for _, v in kmeans._limbs(total))


def test_query_equals_sql_and_brute_force(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    got = sorted((tuple(r) for r in kmeans.digest(spark.read.parquet(path)).collect()), key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert got == sorted(con.execute(kmeans.ORACLE).fetchall(), key=key)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(path).collect()]
    assert got == sorted(brute(rows, 8, 10, 64), key=key)
