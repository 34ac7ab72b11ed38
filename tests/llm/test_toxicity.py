import random
from collections import Counter

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.toxicity import DRIFT, Model, segments


def brute_segments(n, gain):
    """Recursive definition: the best segment (earliest, shortest), then the same on either side."""
    s = [gain.get(i, -DRIFT) for i in range(n)]

    def of(a, b):
        best = max(((round(sum(s[i : j + 1]), 9), -(j - i), -i) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return of(a, i) + [(i, j, best[0])] + of(j + 1, b)

    return of(0, n)


def test_segments_are_the_definition():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 40)
        gain = {i: rng.choice([0.37, 1.01, 2.13, 5.5]) + rng.random() / 1000 for i in range(n) if rng.random() < 0.25}
        got = segments(sorted(gain), [gain[i] for i in sorted(gain)])
        want = brute_segments(n, gain)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want))


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7)))
    common = [word() for _ in range(200)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(common) if rng.random() < 0.8 else word() for _ in range(rng.randrange(20, 150))]
        bad = i % 8 == 0
        if bad:
            for _ in range(rng.randrange(3, 9)):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "Vile!", "zorgk" + word(), "(HATEFUL)"]))
        rows.append((i, " ".join(words), rng.choice("xy")))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learns_and_holds_out(spark):
    rows, labels = corpus()
    extra = [(5000, None, "x"), (5001, "", "x"), (None, "nasty vile hateful nasty zorgkx vile", "x"), (5002, "abc " * 40_000 + "nasty vile hateful nasty vile", "x"), (8, rows[8][1], "again")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + extra], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    wrong = [i for i, _, y in labels if any(r.predicted != y for r in by[i])]
    assert not wrong, wrong
    held = {r.doc_id for r in got if r.held_out}
    assert held and all(__import__("zlib").crc32(str(i).encode()) % 4 == 2 for i in held)
    assert [by[k][0].predicted for k in (5000, 5001, None, 5002)] == [0, 0, 1, 1]
    assert len(by[8]) == 2 and len({r.score for r in by[8]}) == 1
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, y in labels if not y} | {5000, 5001}


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flip = [(i, q, 1 - y if __import__("zlib").crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    out = [sorted(map(tuple, toxicity.digest(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flip)]
    assert out[0] == out[1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.digest(docs, none).collect()] == [(0.0, 0)] * 2
    assert toxicity.digest(docs.limit(0), none).collect() == []
    assert Model().probability(50.0) == 0.0


def test_scale_is_the_likelihood():
    """K of simulated best segments, some of them none (their tail is all that is known)."""
    import math

    rng, lam, k = random.Random(3), 1.3, 0.02
    best = []
    for _ in range(20_000):
        n = rng.randrange(20, 200)
        s = math.log(k * n / rng.expovariate(1.0)) / lam
        best.append((max(s, 0.0), n))
    assert abs(toxicity._scale(lam, best) / k - 1) < 0.05
    assert toxicity._scale(1.0, []) > 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "b", 2)], "doc_id long, text string, passages string, evidence int")
    assert toxicity.score(df, Model()).columns == ["doc_id", "text", "evidence", "score", "passages"]


def test_sample_is_bounded_by_rows(spark):
    """One id many times, with one text and with many; null ids have no label; equal rows count once."""
    rows = [(4, f"text {i % 900}") for i in range(5000)] + [(i, f"own {i}") for i in range(5, 400)] + [(None, f"null {i}") for i in range(200)] + [(7, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(4, 400)] + [(None, 1)], "doc_id long, toxic int")
    drawn = [sorted(toxicity.sample(d, marks, 40, 150).collect(), key=str) for d in (docs, docs.repartition(3))]
    assert drawn[0] == drawn[1]
    assert Counter(r.toxic for r in drawn[0]) == {1: 40, 0: 150}
    assert not any((r.text or "").startswith("null") for r in drawn[0])
    whole = toxicity.sample(docs, marks).collect()
    held = {i for i in range(4, 400) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
    assert len(whole) == len({(i, t) for i, t in rows if i is not None and i not in held})
    # a text is in one fold, whoever has it
    again = toxicity.sample(docs.withColumn("doc_id", docs["doc_id"] + 1), marks).collect()
    fold = {r.text: r.fold for r in whole}
    assert all(fold.get(r.text, r.fold) == r.fold for r in again)


def test_level_is_the_likeliest():
    """The level whose evidence parts the labels; of equal ones the strictest."""
    toxic, count = np.array([0.0, 0, 1, 1]), np.array([500.0, 20, 30, 40])
    evidence = np.zeros((4, len(toxicity.LEVELS)))
    evidence[1, :2] = 3.0  # chance passages at the two loosest levels
    evidence[2:, :4] = 5.0  # toxic ones at all but the two strictest
    level, intercept, slope = toxicity._choose(evidence, toxic, count)
    assert level == toxicity.LEVELS[3] and slope > 0 > intercept
    order = [2, 0, 3, 1]
    assert toxicity._choose(evidence[order], toxic[order], count[order]) == (level, intercept, slope)
    # counts stand for rows
    each = np.repeat(np.arange(4), count.astype(int))
    one = toxicity._choose(evidence[each], toxic[each], np.ones(len(each)))
    assert one[0] == level and abs(one[1] - intercept) < 1e-6 and abs(one[2] - slope) < 1e-6
    assert toxicity._choose(np.zeros((4, len(toxicity.LEVELS))), toxic, count)[0] == toxicity.LEVELS[-1]
