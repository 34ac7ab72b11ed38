from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing


def brute_targets(size, weights, cap):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, open_, total = {}, set(names), sum(size.values())
    while open_:
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * size[s]}
        if not above:
            return full | share
        for s in above:
            full[s] = cap * size[s]
        open_ -= above
    return full


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        source = "hot" if i % 3 == 0 else [None, "a", "b", "é", "z", "tiny"][int(rng.integers(6)) if i % 50 else 5]
        rows.append((i, source, " ".join(["w"] * int(rng.lognormal(3, 1)))))
    rows += [(None, "a", None), (5, "hot", ""), (5, "hot", "again again"), (5, "hot", "again again"), (6, "empty", None)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, size int").drop("size")


def test_targets_and_rounding(spark, docs):
    got = mixing.mix(mixing.sizes(docs), group=128, fan=4).collect()
    assert len(got) == docs.count()
    size, taken, copies = Counter(), Counter(), defaultdict(list)
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        copies[r.source].append(r)
    want = brute_targets(size, mixing.WEIGHTS, mixing.CAP)
    for s, rows in copies.items():
        assert {round(r.target, 6) for r in rows} == {round(want[s], 6)}
        assert all(0 <= r.copies <= 3 and r.source_size == size[s] for r in rows)
        rate = want[s] / size[s] if size[s] else 0
        assert all(r.copies in (int(rate), int(np.ceil(rate))) or not r["size"] for r in rows)
        assert abs(taken[s] - want[s]) <= 0.005 * want[s] + 12
    again = mixing.mix(mixing.sizes(docs.repartition(7)), group=128, fan=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_one_row_many_times(spark):
    """Equal rows, null ids: a third of all; each within one of the others, and the source is met."""
    rows = [(i, "a", "w " * (i % 7 + 1), i) for i in range(3000)] + [(7, "b", "one two three", 0)] * 2000 + [(None, "c", None, 0)] * 500 + [(None, "c", "x y", 1)] * 900
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, rows int").repartition(5)
    got = mixing.mix(mixing.sizes(docs), group=64, fan=4).toPandas()
    assert len(got) == len(rows)
    for key, part in got[got["size"] > 0].groupby("source"):
        rate = part["target"].iloc[0] / part["source_size"].iloc[0]
        assert set(part["copies"]) <= {int(rate), int(np.ceil(rate))}
        assert abs((part["copies"] * part["size"]).sum() - part["target"].iloc[0]) <= 8
    mixed = [sorted(map(str, mixing.mixed_documents(d).collect())) for d in (docs, docs.repartition(3))]
    assert mixed[0] == mixed[1] and len(mixed[0]) == mixing.mix(mixing.sizes(docs)).toPandas()["copies"].sum()


def test_rows_alike_share_what_is_over(spark, monkeypatch):
    """Rows equal in id, source and text, some in all columns: copies of each number are those of one order of all."""
    monkeypatch.setattr(mixing, "GROUP", 16)
    rows = [(1, "a", "one two three", i % 40) for i in range(700)] + [(1, "a", "one two three", 99)] * 300 + [(None, None, "x y", 5)] * 77 + [(2, "a", "four five", 1), (3, "b", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _n int").repartition(3)
    entry = {(r.doc_id, r.source, r["size"]): (r.copies, r.rows) for r in mixing.entries(mixing.sizes(docs)).collect()}
    got = Counter(tuple(r) for r in mixing.mixed_documents(docs).collect())
    hashed = docs.select("*", mixing.F.xxhash64(mixing.F.struct(*docs.columns)).alias("h")).collect()
    want: Counter = Counter()
    for (doc_id, source, size), (copies, n) in entry.items():
        same = sorted((r for r in hashed if (r.doc_id, r.source, len((r.text or "").split())) == (doc_id, source, size)), key=lambda r: r.h)
        assert len(same) == n
        for k, r in enumerate(same):
            want[tuple(r)[:4]] += copies // n + (k < copies % n)
    assert got == Counter({k: v for k, v in want.items() if v})


def test_expectation_is_kept():
    size, x0 = np.array([9.0, 5, 4, 2, 1, 1]), np.full(6, 0.3)
    total = np.zeros(6)
    for k in range(6000):
        x = x0.copy()
        left = mixing.pivot(size, x, np.random.default_rng(k))
        assert abs((x * size).sum() - (x0 * size).sum()) < 1e-9
        assert sum(0 < v < 1 for v in x) == (left >= 0)
        total += x
    assert np.abs(total / 6000 - 0.3).max() < 0.03


def test_pool_keeps_words_and_expectation():
    size, total = np.array([40.0, 12, 9, 7, 5, 4, 4, 3, 2, 2, 1, 1, 1]), np.zeros(13)
    for k in range(6000):
        x = np.full(13, 0.4)
        left = mixing.pooled(size, x, np.random.default_rng(k))
        assert abs((x * size).sum() - 0.4 * size.sum()) < 1e-9 and sum(0 < v < 1 for v in x) == (left >= 0)
        total += x
    assert np.abs(total / 6000 - 0.4).max() < 0.03


def test_documents_and_empty(spark, docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = sum(r.copies for r in mixing.mix(mixing.sizes(docs)).collect())
    assert mixed.count() == want
    assert mixing.digest(docs.limit(0)).collect() == []
    assert mixing.mix(mixing.sizes(docs.filter("text is null"))).filter("copies > 0").count() == 0


def test_last_document_is_made_up_for():
    """Few documents of uneven sizes: the rest is as small as flips and changed places allow, integral everywhere."""
    gaps = []
    for k in range(200):
        rng = np.random.default_rng(k)
        size = np.sort(rng.lognormal(4.5, 1.3, 50).astype(int) + 1)[::-1].astype(float)
        share = rng.uniform(0.05, 0.95)
        x = np.full(50, share)
        left = mixing.pooled(size, x, rng)
        if left >= 0:
            mixing.close(size, x, left, rng)
        assert set(x) <= {0.0, 1.0}
        gaps.append(abs((x * size).sum() - share * size.sum()) / (share * size.sum()))
    assert np.mean(np.array(gaps) > 0.01) < 0.05 and np.median(gaps) < 0.001


def test_closing_few_documents_against_all_choices():
    """Never further off than rounding the last one alone; exact where two changed places are enough."""
    size = np.array([100.0, 60, 45, 30])
    x = np.array([0.5, 1.0, 0.0, 0.0])
    mixing.close(size, x, 0, np.random.default_rng(1))
    best = min(abs(110 - sum(s for s, b in zip(size, bits) if b)) for bits in np.ndindex(2, 2, 2, 2))
    assert best == abs(110 - (x * size).sum()) or abs(110 - (x * size).sum()) <= 15
    for k in range(300):
        rng = np.random.default_rng(k)
        size, x = rng.integers(1, 90, 8).astype(float), rng.integers(0, 2, 8).astype(float)
        x[3] = rng.uniform(0.01, 0.99)
        want, alone = (x * size).sum(), min(x[3], 1 - x[3]) * size[3]
        mixing.close(size, x, 3, rng)
        assert set(x) <= {0.0, 1.0} and abs((x * size).sum() - want) <= alone + 1e-9
