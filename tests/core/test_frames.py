"""Windows out of frames: equal to the folds, and without a frame that is added up anew for every row."""

import re

import pytest
from pyspark.sql import functions as F

from tests.core.test_detector import CONFIG
from tests.core.test_stretches import skewed
from tidemark.operators import fold, score, windows
from tidemark.plans import registry
from tidemark.plans.settings import DETECTOR
from tidemark.sources.adapter import read_events


def sliding(df):
    """Frames of more than a row that don't begin where their partition does, and lists that are collected."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+), ([^)]+(?:\(\))?)\)", plan)
    assert frames
    return [f for f in frames if f[0] != "unboundedpreceding$()" and f[0] != f[1]] + re.findall("collect_list", plan)


@pytest.mark.parametrize("keys,closed,span", [(["bin"], False, 30_000), (["merchant_id", "bin"], True, 900), (["bin"], True, 0)])
def test_long_spans(spark, keys, closed, span):
    df = spark.createDataFrame(skewed())
    got = windows.time_window_cards(df, keys, span, closed, "t")
    assert not sliding(got)
    want = fold.trailing_fold(df, keys, span, closed, "t")
    assert got.select(*want.columns).orderBy("seq").collect() == want.orderBy("seq").collect()


@pytest.mark.parametrize("capacity", [None, 7])
def test_window_counts(spark, capacity):
    df = spark.createDataFrame(skewed())
    got = windows.with_window_count(df, "merchant_id", CONFIG.window_ms, "n", capacity)
    assert not sliding(got)
    want = df.withColumn("n", windows.window_count("merchant_id", CONFIG.window_ms, capacity))
    assert got.orderBy("seq").collect() == want.orderBy("seq").collect()


def test_occupancy(spark):
    df = spark.createDataFrame(skewed())
    got = windows.occupancy(df, ["bin", "merchant_id"], CONFIG.window_ms, 7)
    assert not sliding(got)
    found = {r.axis: (r.entities, r.buffered_events, r.saturated_entities) for r in got.collect()}
    for axis in ("bin", "merchant_id"):
        last = {}
        for r in fold.entity_fold(df, axis, CONFIG.with_(ring_capacity=7), "w", True).orderBy("ts", "seq").collect():
            last[r[axis]] = r
        assert found[axis] == (len(last), sum(r.w_events for r in last.values()), sum(r.w_saturated for r in last.values()))


@pytest.mark.parametrize("capacity", [7, 10**6])
def test_entity_windows(spark, capacity):
    df = spark.createDataFrame(skewed())
    got = windows.entity_windows(df, "bin", CONFIG.window_ms, capacity)
    assert not sliding(got)
    names = ["seq", *(f"window_{n}" for n in ("events", "declines", "amount", "cards", "merchants"))]
    want = fold.entity_fold(df, "bin", CONFIG.with_(ring_capacity=capacity), "window", True)
    assert got.select(*names).orderBy("seq").collect() == want.select(*names).orderBy("seq").collect()


def test_parity_folds_what_it_compares(spark):
    """The ratio is of the bin's window: rows aren't dealt and folded by ip for it."""
    ours, plain = registry._two_sides(spark, "/root/testdata/sf0.001")
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bin" in plan and "hashpartitioning(ip" not in plan
    full = score.scored(read_events(spark, "/root/testdata/sf0.001"), DETECTOR).select("txn_id", "seq", F.col("window_decline_ratio").alias("score"))
    assert sorted(ours.collect()) == sorted(full.collect())
