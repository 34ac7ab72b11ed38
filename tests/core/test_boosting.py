"""Leaf-wise boosting against one node at a time in plain Python."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.plans import registry
from tidemark.session import tables_dir


def brute(rows, bounds, rounds, rate, leaves, least):
    """Trees as lists of (path, feature, bin) in the order of their splits, and the margins of all rows."""
    positive = sum(y for _, y in rows)
    margins = [math.log(positive / (len(rows) - positive))] * len(rows)
    bins = [[sum(v > b for b in bound) for v, bound in zip(x, bounds)] for x, _ in rows]
    trees = []
    for _ in range(rounds):
        g = [round((1 / (1 + np.exp(-m)) - y) * boosting.UNIT) for m, (_, y) in zip(margins, rows)]
        h = [round((p := 1 / (1 + np.exp(-m))) * (1 - p) * boosting.UNIT) for m in margins]
        nodes = {1: list(range(len(rows)))}
        splits = []
        while len(nodes) < leaves:
            best = None
            for place, members in sorted(nodes.items()):
                total = sum(g[i] for i in members), sum(h[i] for i in members)
                for f in range(len(bounds)):
                    for b in range(boosting.BINS):
                        left = [i for i in members if bins[i][f] <= b]
                        if len(left) < least or len(members) - len(left) < least:
                            continue
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gr, hr = total[0] - gl, total[1] - hl
                        if min(hl, hr) < boosting.LEAST_CURVATURE * boosting.UNIT:
                            continue
                        gain = float(gl) * gl / hl + float(gr) * gr / hr - float(total[0]) ** 2 / total[1]
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, place, f, b)
                        if b >= max(bins[i][f] for i in members):
                            break
            if best is None:
                break
            _, place, f, b = best
            splits.append((place, f, b))
            members = nodes.pop(place)
            nodes[2 * place] = [i for i in members if bins[i][f] <= b]
            nodes[2 * place + 1] = [i for i in members if bins[i][f] > b]
        if not splits:
            break
        for members in nodes.values():
            value = -rate * sum(g[i] for i in members) / sum(h[i] for i in members)
            for i in members:
                margins[i] += value
        trees.append(set(splits))
    return trees, margins


def splits_of(tree):
    found, todo = set(), [(0, 1)]
    while todo:
        at, place = todo.pop()
        if tree.feature[at] >= 0:
            found.add((place, int(tree.feature[at]), int(tree.cut[at])))
            todo += [(int(tree.left[at]), 2 * place), (int(tree.right[at]), 2 * place + 1)]
    return found


@pytest.mark.parametrize("leaves,rewrite", [(9, 2)])
def test_trees_are_grown_best_first(spark, monkeypatch, leaves, rewrite):
    monkeypatch.setattr(boosting, "REWRITE", rewrite)
    rng = random.Random(leaves)
    rows = []
    for _ in range(170):
        x = [round(rng.random(), 2), float(rng.randrange(6)), rng.gauss(0, 1)]
        rows.append((x, int(rng.random() < 1 / (1 + math.exp(-(6 * (x[0] - 0.5) * (1 if x[1] > 2 else -1) + x[2]))))))
    df = spark.createDataFrame([(*x, y) for x, y in rows], "a double, b double, c double, label int")
    model = boosting.fit(df.repartition(3), ["a", "b", "c"], rounds=3, rate=0.3, leaves=leaves, least_rows=7, bins=12)
    trees, margins = brute(rows, model.bounds, 3, 0.3, leaves, 7)
    assert [splits_of(t) for t in model.trees] == trees and all(len(t) == leaves - 1 for t in trees)
    got = [r.score for r in model.margins(df).collect()]
    assert np.allclose(got, margins, rtol=0, atol=1e-12)
    again = boosting.fit(df.repartition(5), ["a", "b", "c"], rounds=3, rate=0.3, leaves=leaves, least_rows=7, bins=12)
    assert [r.score for r in again.margins(df).collect()] == got  # however rows fall into tasks


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(50)], "a double, label int")
    one = boosting.fit(df, ["a"], rounds=3)
    assert not one.trees and one.margins(df).filter("score > 0").count() == 50
    assert not boosting.fit(df.limit(0), ["a"], rounds=3).trees
    same = df.withColumn("a", F.lit(1.0)).withColumn("label", (F.rand(1) > 0.5).cast("int"))
    assert not boosting.fit(same, ["a"], rounds=3).trees  # nothing to split by


def test_a_pass_sums_one_of_two_children_and_applies_no_old_tree(spark, monkeypatch):
    drawn = [(float(k % 17), float(k * 7 % 23), int(k % 17 + k * 7 % 23 > 20)) for k in range(300)]
    df = spark.createDataFrame(drawn, "a double, b double, label int")
    want = boosting.fit(df, ["a", "b"], rounds=3, leaves=4)
    whole, passes = boosting._histograms, []
    monkeypatch.setattr(boosting, "_histograms", lambda rows, n, tree, wanted, trees: passes.append((wanted.max() + 1, tree, len(trees))) or whole(rows, n, tree, wanted, trees))
    monkeypatch.setattr(boosting, "MANY", 100)
    got = boosting.fit(df, ["a", "b"], rounds=3, leaves=4)
    assert [t.value.tolist() for t in got.trees] == [t.value.tolist() for t in want.trees]
    assert max(p[2] for p in passes) == 0
    assert all(2 * nodes <= (tree.feature < 0).sum() for nodes, tree, _ in passes if len(tree.feature) > 1)


@pytest.mark.parametrize("many,rewrite", [(10**6, 1), (0, 2)])
def test_equal_rows_are_one_group_in_one_task_and_in_passes(spark, monkeypatch, many, rewrite):
    monkeypatch.setattr(boosting, "MANY", many)
    monkeypatch.setattr(boosting, "REWRITE", rewrite)
    whole, seen = boosting._groups, []
    monkeypatch.setattr(boosting, "_groups", lambda *a: seen.append(whole(*a)) or seen[-1])
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        x = [float(rng.randrange(4)), *[0.0] * 7, float(rng.randrange(5))]
        rows.append((x, int(rng.random() < 1 / (1 + math.exp(-(x[0] - 1.5) * (x[8] - 2.0))))))
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame([(*x, y) for x, y in rows], ", ".join(f"{c} double" for c in names) + ", label int").repartition(3)
    before = set(os.listdir(tables_dir(spark))) if os.path.isdir(tables_dir(spark)) else set()
    model = boosting.fit(df, names, rounds=5, rate=0.3, leaves=5, least_rows=7)
    assert {name.split("-")[1] for name in set(os.listdir(tables_dir(spark))) - before} == {"groups" if many else "rows"}
    assert len(set(os.listdir(tables_dir(spark))) - before) == 1  # margins that are out of date are gone
    trees, margins = brute(rows, model.bounds, 5, 0.3, 5, 7)
    assert len(trees) == 5 and [splits_of(t) for t in model.trees] == trees
    scored = model.margins(spark.createDataFrame([(k, *x) for k, (x, _) in enumerate(rows)], "k int, " + ", ".join(f"{c} double" for c in names)))
    assert np.allclose([r.score for r in scored.orderBy("k").collect()], margins, rtol=0, atol=1e-12)
    if many:
        assert seen[0].agg(F.count(F.lit(1)), F.sum("n")).first() == (len({(*x, y) for x, y in rows}), 300)


def test_the_query_fits_all_its_rounds(spark, monkeypatch):
    whole, fitted = boosting.fit, []
    monkeypatch.setattr(boosting, "fit", lambda *a, **k: fitted.append(whole(*a, **k)) or fitted[-1])
    assert registry.QUERIES["learned_leafwise"](spark, "/root/testdata/sf0.001").count() == 1
    assert [len(m.trees) for m in fitted] == [200]
