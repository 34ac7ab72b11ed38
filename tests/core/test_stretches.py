"""Parts of keys and streams against their whole: composed gates, visits, states that are carried over."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.core.test_detector import CONFIG, events
from tidemark.operators import fold, score, spans, stretches


def walk(times, interval, due=stretches.NEVER):
    """The samples of times in order, and when the gate is due after them."""
    taken = []
    for i, t in enumerate(times):
        if t >= due:
            taken.append(i)
            due = t + interval
    return taken, due


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=80), st.integers(1, 120), st.data())
def test_steps_are_the_gate(times, interval, data):
    times = sorted(times)
    upto, after = stretches.gate_steps(np.array(times, np.int64), interval)
    assert (np.diff(after) != 0).all() and (np.diff(upto) > 0).all()
    for due in [stretches.NEVER, *data.draw(st.lists(st.integers(-50, times[0] + interval), max_size=30))]:
        assert stretches.applied(due, upto, after)[0] == walk(times, interval, due)[1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 600), min_size=1, max_size=120), st.integers(1, 90), st.lists(st.integers(1, 600), max_size=6))
def test_composed_steps_are_the_whole_gate(times, interval, marks):
    times = sorted(times)
    parts = np.split(np.array(times, np.int64), np.searchsorted(times, sorted(marks)))
    whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in parts:
        if len(part):
            whole = stretches.composed(whole, stretches.gate_steps(part, interval))
    assert stretches.applied(stretches.NEVER, *whole)[0] == walk(times, interval)[1]


@pytest.mark.parametrize("fan", [2, 64])
def test_dues_come_down_the_tree(spark, fan):
    rng = random.Random(3)
    rows = [(key, i // 7, t) for key in "ab" for i, t in enumerate(sorted(rng.randrange(3000) for _ in range(160)))]
    rows = [(k, s, t) for k, s, t in rows if s != 4]  # a stretch without times
    df = spark.createDataFrame(rows, "_key string, _stretch long, ts long")
    got = {(r._key, r._stretch): r.due for r in stretches.entry_dues(stretches.step_tables(df, 100), fan).collect()}
    for key in "ab":
        due = stretches.NEVER
        for stretch in sorted({s for k, s, _ in rows if k == key}):
            assert got[key, stretch] == due
            due = walk([t for k, s, t in rows if k == key and s == stretch], 100, due)[1]


def skewed(n=1800):
    """A stream in which one bin and one ip have most events, some of them at one time."""
    rng, out = random.Random(5), []
    for r in events(n, seed=9):
        if rng.random() < 0.7:
            r = dict(r, bin="000009", ip="192.0.2.9", merchant_id="m0", card_ref=rng.choice(["c0", r["card_ref"]]))
        out.append(r)
    return out


@pytest.mark.parametrize("config", [CONFIG, CONFIG.with_(use_ewma=False, use_per_ip=False, long_window_ms=40_000), CONFIG.with_(sample_interval_ms=0, use_per_ip=False)])
def test_a_hot_key_among_cold_ones(spark, config):
    df = spark.createDataFrame(skewed())
    a, b = (score.fold(df, config, hot=h).orderBy("seq").collect() for h in (300, 10**9))
    assert a == b and len(a) == 1800
    assert stretches.prepared(df, "bin", config, True, 300).cut.keys.count() == 1


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Join")


def test_cold_streams_are_folded_as_ever(spark):
    """Above the limit, but without a hot key: two exchanges, no join."""
    df = spark.createDataFrame(events(900))
    assert exchanges(score.fold(df, CONFIG, hot=600)) == exchanges(score.fold(df, CONFIG)) == (2, 0)


@pytest.mark.parametrize("keys,closed,some", [(["bin"], False, (1, 30_000)), (["merchant_id", "bin"], True, (900, 10**7))])
def test_trailing_spans_in_stretches(spark, keys, closed, some):
    df = spark.createDataFrame(skewed()).drop("device_id")
    for span in some:
        split = spans.trailing(df, keys, span, closed, "t", hot=250)
        whole = fold.trailing_fold(df, keys, span, closed, "t")
        assert split.columns == whole.columns
        assert split.orderBy("seq").collect() == whole.orderBy("seq").collect()


def test_cuts_read_no_cell_twice(spark, monkeypatch):
    """No frame reaches to the end of a key: Spark reads such a frame anew for each cell."""
    plans, put = [], stretches.written
    monkeypatch.setattr(stretches, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower()) or put(df, name))
    df = spark.createDataFrame(skewed()).withColumn("_key", F.col("bin"))
    cut = stretches.cuts(df, stretches.busy_keys(df, "bin", 300), 40, 1)
    assert "windowframe" in plans[-1] and "unboundedfollowing" not in plans[-1]
    found = cut.cells.orderBy("_cell").collect()
    starts = {r._stretch: cut.keys.first()._from + r._cell * cut.keys.first()._width for r in reversed(found)}
    assert all(r._next == starts.get(r._stretch + 1) for r in found) and len(starts) > 20


def test_states_carry_streams_over(spark):
    """Parts of a stream, each starting from the table of states that the one before has left, are the whole stream."""
    df = spark.createDataFrame(skewed())
    whole = fold.entity_fold(df, "bin", CONFIG, "b", True).orderBy("seq").collect()
    end = df.agg(F.max("ts")).first()[0]
    states, got = None, []
    for low, high in [(0, end // 3), (end // 3, end // 2), (end // 2, end + 1)]:
        part = df.filter((F.col("ts") >= low) & (F.col("ts") < high))
        got += fold.warm_fold(part, "bin", CONFIG, "b", True, states).collect()
        states = stretches.written(fold.end_states(part, "bin", CONFIG, states), "states")
    assert sorted(got, key=lambda r: r.seq) == whole
    same = fold.end_states(df, "bin", CONFIG).orderBy("bin").collect()
    assert states.orderBy("bin").collect() == same
    # a state without events stays; an entity left out of the table starts anew
    assert fold.end_states(df.limit(0), "bin", CONFIG, states).orderBy("bin").collect() == same
    reset = fold.warm_fold(df, "bin", CONFIG, "b", True, states.filter("bin <> '000009'"))
    fresh = {r.seq: r for r in whole if r.bin == "000009"}
    rows = reset.collect()
    assert all(r == fresh[r.seq] for r in rows if r.bin == "000009")
    assert all(r.b_samples > 0 for r in rows if r.bin != "000009")
    assert fold.end_states(df.limit(0), "bin", CONFIG).collect() == []


def test_states_travel_as_text(spark):
    # a batch's size is asked for at every row: a struct's vectors beside each row took most of the time
    rows = spark.createDataFrame([(k, k, 1 + k % 3) for k in range(9)], "ts long, seq long, n long")
    found = stretches.with_unkeyed_baseline_in_one(rows, "n", CONFIG)
    resumed = fold.warm_fold(spark.createDataFrame(events(20)), "bin", CONFIG, "b", True, None)
    for df in (found, resumed):
        given = df._jdf.queryExecution().analyzed().children().head().schema().simpleString()
        assert f"{fold.RESUME}:string" in given and "struct<held" not in given


@pytest.mark.parametrize("interval", [0, 4, 50])
def test_an_unkeyed_baseline_steps_over_rows_between_samples(spark, interval):
    config = CONFIG.with_(sample_interval_ms=interval)
    drawn = random.Random(interval)
    rows = [(t, k, drawn.randrange(1, 9)) for k, t in enumerate(sorted(drawn.randrange(200) for _ in range(150)))]
    one, want = fold.Entity(config, False), {}
    for ts, seq, n in rows:
        want[seq] = one.known()[:3]
        if one.last is None or ts - one.last >= interval:
            one.last = ts
            one.learn(n, 0, 0)
    df = spark.createDataFrame(rows, "ts long, seq long, n long")
    for found in (stretches.with_unkeyed_baseline_in_one(df, "n", config), stretches.with_unkeyed_baseline(df, "n", config, 20)[0]):
        assert {r.seq: (r.all_samples, r.all_mean, r.all_spread) for r in found.collect()} == want


@pytest.mark.parametrize("interval", [0, 4])
def test_gates_read_a_time_once(spark, monkeypatch, interval):
    """Rows of equal times go to the gates and samples as the first of them, and the baseline is the one of all rows."""
    read, put = {}, stretches.written
    monkeypatch.setattr(stretches, "written", lambda df, name: read.setdefault(name, put(df, name)))
    config = CONFIG.with_(sample_interval_ms=interval)
    rows = [(t, (k * 7) % 11 + 11 * t, 1 + (k * t) % 5) for t in range(30) for k in range(11)]
    df = spark.createDataFrame(rows, "ts long, seq long, n long")
    found = stretches.with_unkeyed_baseline(df, "n", config, 20)[0]
    assert read["gate-times"].count() == (30 if interval else 330)
    whole = stretches.with_unkeyed_baseline_in_one(df, "n", config)
    assert found.orderBy("seq").collect() == whole.select(*found.columns).orderBy("seq").collect()
