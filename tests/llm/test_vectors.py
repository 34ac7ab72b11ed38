import numpy as np
import pandas as pd

from tidemark.llm import vectors


def data():
    rng = np.random.default_rng(12)
    x = [rng.normal(size=24) for _ in range(500)]
    for k in range(25):
        base = x[k]
        x += [base + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.35]) * np.abs(base).mean() for _ in range(rng.integers(1, 6))]
    centre = rng.normal(size=24)
    x += [centre + 0.05 * rng.normal(size=24) for _ in range(150)]
    x += [x[3], 2 * np.array(x[3]), x[3], -np.array(x[4])]
    rows = [(int(i) * 7 % 1009, [float(np.float32(v)) for v in vec]) for i, vec in enumerate(x)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [None] + [1.0] * 23)]
    rows += [(None, rows[3][1]), (5, rows[8][1]), (5, rows[9][1]), (None, [3.0, -1.0])]
    return rows


def brute(rows):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9:
                    links[i].add(j)
                    links[j].add(i)
    out, comp = [], [None] * n
    for i in range(n):
        if comp[i] is None:
            stack, seen = [i], {i}
            while stack:
                for j in links[stack.pop()] - seen:
                    seen.add(j)
                    stack.append(j)
            least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
            for k in seen:
                comp[k] = (least,)
        out.append((rows[i][0], len(links[i]), comp[i][0], rows[i][0] == comp[i][0]))
    return sorted(out, key=str)


def test_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(5)
    want = brute(rows)
    for options in ({}, {"region": 120, "block": 100}):
        got = vectors.near_duplicates(df, **options)
        measured = {r.recall for r in got.collect()}
        out = sorted((tuple(r)[:4] for r in got.collect()), key=str)
        assert len(out) == len(rows) and got.columns == ["vec_id", "n_links", "component_id", "kept", "recall"]
        assert len(measured) == 1 and 0.9 <= min(measured) <= 1.0
        true, found = sum(w[1] for w in want), sum(g[1] for g in out)
        assert found <= true and found >= 0.97 * true
        same = sum(a == b for a, b in zip(out, want))
        assert same >= 0.95 * len(want)
        assert vectors.recall(df.filter("vec_id <> 5"), got.filter("vec_id <> 5"), every=5) >= 0.95
    assert vectors.digest(df.limit(0)).collect() == []


def test_graph_search_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    x[700:1000] = x[0] + 0.2 * rng.normal(size=(300, 32))
    x[1000:1100] = x[100:200] + 0.3 * rng.normal(size=(100, 32))
    x = vectors._unit(x).astype(np.float32)
    adjacency, medoids = vectors.graph(x, rng)
    queries = np.arange(0, 1500, 3)
    truth = vectors._outright(x, queries, 0.9)
    got = vectors.search(x, adjacency, medoids, queries, 0.9)
    assert (got & ~truth).sum() == 0
    assert (got & truth).sum() >= 0.95 * truth.sum()


def test_dense_group_of_distinct_near_copies_is_whole(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(33_000, 64))
    # noise of norm 0.25 on a unit vector: pairs at a cosine of about 0.94
    x[:30_000] = vectors._unit(x[:1]) + 0.25 / 8 * x[:30_000]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(8)
    got = vectors.near_duplicates(df).cache()
    assert vectors.recall(df, got) >= 0.999
    # exact on some rows, and one component
    small = vectors._unit(x)
    for r in got.filter("vec_id % 5000 = 1").collect():
        assert r.n_links == int((small @ small[r.vec_id] >= 0.9).sum()) - 1
    assert got.filter("vec_id < 30000 and component_id = 0").count() == 30_000
    got.unpersist()


def test_failing_audit_ends_exact(spark):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    # no recall is enough, so the last way is taken
    got = vectors.near_duplicates(df, least_recall=1.1, region=120, block=100).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows) and {r.recall for r in got} == {1.0}


def test_a_graph_that_finds_nothing_is_not_asked(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + 0.1 * rng.normal(size=(300, 16))  # one link a vector
    x = vectors._unit(x)
    everyone, ids, ones = np.arange(600), rng.permutation(600), np.ones(600, np.int64)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    only_itself = lambda x, adjacency, medoids, queries, threshold, of: queries[:, None] == np.arange(len(x))[None, :]
    monkeypatch.setattr(vectors, "search", only_itself)
    links, _, wanted, found = vectors.region_links(ids, x, ones, [[0]] * 600, 0, everyone, everyone)
    assert wanted > 0 and found == 0 and (links == want).all()


def test_nearest_regions_of_joined_centres():
    rng = np.random.default_rng(2)
    x, c = vectors._unit(rng.normal(size=(50, 8))), vectors._unit(rng.normal(size=(20, 8)))
    label = np.array([min(k, 4) if k % 3 else k for k in range(20)])
    for row, found in zip(x, vectors._nearest(x, c, label, 3).tolist()):
        seen = []
        for k in np.argsort(-(c @ row)):
            if label[k] not in seen:
                seen.append(label[k])
        assert found == seen[:3]
