import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import CostModel, TriageConfig
from tidemark.operators import costs, graph, metrics, splits, sweep, triage

MIN = 60_000


def rows_of(spark, items):
    full = [dict(dict(merchant_id="m", bin="000001", txn_id=f"t{i}", amount_paise=100, status="approved", label=0, scenario_id="benign", card_ref=f"c{i}", seq=i), **r) for i, r in enumerate(items)]
    return spark.createDataFrame([{k: r[k] for k in sorted(r)} for r in full], "amount_paise long, bin string, card_ref string, label int, merchant_id string, scenario_id string, score double, seq long, status string, ts long, txn_id string")


def sample(spark, n=400, seed=3):
    import random

    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, MIN, 5 * MIN, 16 * MIN])
        out.append(dict(ts=t, score=rng.choice([rng.random() * 10, float(rng.randrange(10))]), label=rng.randrange(2), status=rng.choice(["approved", "declined"]), amount_paise=rng.randrange(100, 900), merchant_id=f"m{rng.randrange(2)}", bin=f"00000{rng.randrange(2)}", scenario_id=rng.choice(["benign", "burst"])))
    return out


def test_confusion_and_average_precision(spark):
    items = sample(spark)
    df = rows_of(spark, items)
    got = metrics.confusion(df, 5.0).first()
    tp = sum(r["score"] > 5 and r["label"] for r in items)
    fp = sum(r["score"] > 5 and not r["label"] for r in items)
    fn = sum(r["score"] <= 5 and r["label"] for r in items)
    assert (got.tp, got.fp, got.fn, got.tn) == (tp, fp, fn, len(items) - tp - fp - fn)
    assert got.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
    ordered = sorted(range(len(items)), key=lambda i: (-items[i]["score"], i))
    hits, area = 0, 0.0
    for k, i in enumerate(ordered):
        if items[i]["label"]:
            hits += 1
            area += hits / (k + 1)
    assert metrics.average_precision(df).first()[0] == pytest.approx(area / hits)
    assert metrics.average_precision(df.filter("label = 0")).first()[0] == 0.0
    assert metrics.confusion(df.limit(0), 5.0).first().precision == 0.0


def recount_alerts(items, threshold, cooldown):
    last, n = {}, 0
    for r in items:
        if r["score"] > threshold:
            k = (r["merchant_id"], r["bin"])
            n += k not in last or r["ts"] - last[k] > cooldown
            last[k] = r["ts"]
    return n


def test_alerts_collapse_and_split(spark):
    run = rows_of(spark, [dict(ts=i * 1000, score=9.0, label=1) for i in range(300)])
    got = metrics.alerts(run, 5.0, 15 * MIN).collect()
    assert [(r.events, r.is_true) for r in got] == [(300, True)]
    for gap, n in ((15 * MIN, 1), (15 * MIN + 1, 2)):
        assert metrics.alerts(rows_of(spark, [dict(ts=0, score=9.0), dict(ts=gap, score=9.0)]), 5.0, 15 * MIN).count() == n
    items = sample(spark)
    assert metrics.alerts(rows_of(spark, items), 3.0, 15 * MIN).count() == recount_alerts(items, 3.0, 15 * MIN)


def test_sweep_is_a_recount_and_selection(spark):
    items = sample(spark)
    model = CostModel()
    swept = sweep.threshold_sweep(rows_of(spark, items), model, 15 * MIN, points=60).orderBy("k").collect()
    assert len(swept) == 60 and swept[-1].threshold == max(r["score"] for r in items) and swept[-1].alerts == 0
    for r in swept:
        above = [x for x in items if x["score"] > r.threshold]
        assert r.alerts == recount_alerts(items, r.threshold, 15 * MIN)
        fraud = [x for x in above if x["label"]]
        gross = 150 * len(fraud) + sum(0.8 * (50_000 + x["amount_paise"]) for x in fraud if x["status"] == "approved") - 0.25 * sum(x["amount_paise"] for x in above if not x["label"] and x["status"] == "approved")
        assert r.gross_paise == pytest.approx(gross) and r.recall == pytest.approx(len(fraud) / sum(x["label"] for x in items))
    for budget in (0.0, 5.0, 12.0, None):
        fits = [r for r in swept if budget is None or r.alerts_per_day <= budget]
        best = max(r.net_paise for r in fits)
        want = max(fits, key=lambda r: r.net_paise) if best <= 0 else min((r for r in fits if r.net_paise >= best * 0.95), key=lambda r: r.threshold)
        df = spark.createDataFrame(swept)
        got = sweep.select_thresholds(df, [budget]).first()
        assert (got.k, got.infeasible) == (want.k, False)
    loud = spark.createDataFrame(swept).filter("k < 10")
    assert sweep.select_thresholds(loud, [0.0]).first().infeasible
    flat = rows_of(spark, [dict(ts=i, score=1.0) for i in range(5)])
    assert {r.alerts for r in sweep.threshold_sweep(flat, model, 1, points=7).collect()} == {0}


def test_hand_worked_costs(spark):
    items = [dict(ts=0, score=10.0, label=1, status="declined"), dict(ts=1, score=10.0, label=1, amount_paise=2000), dict(ts=2, score=10.0, amount_paise=100_000), dict(ts=3, score=10.0, status="declined"), dict(ts=4, score=0.0)]
    got = costs.cost_breakdown(rows_of(spark, items), 5.0, CostModel(), 2).first()
    assert (got.saved_auth_fees_paise, got.avoided_chargebacks_paise, got.blocked_good_paise) == (300, 41_600, 25_000)
    assert (got.blocked_good_events, got.would_decline, got.gross_paise, got.net_paise, got.break_even_paise) == (2, 1, 16_900, 8_900, 8_450)
    assert costs.cost_breakdown(rows_of(spark, items[:2]), 5.0, CostModel(), 0).first().break_even_paise == math.inf
    cf = spark.createDataFrame([(80, 90, 20, 810)], "tp long, fp long, fn long, tn long")
    r = costs.reweighted(cf, 0.01).first()
    assert (r.negative_scale, r.effective_fp, r.recall) == (pytest.approx(11), pytest.approx(990), 0.8) and r.precision_target == pytest.approx(80 / 1070)
    with pytest.raises(Exception):
        costs.reweighted(spark.createDataFrame([(0, 1, 0, 1)], "tp long, fp long, fn long, tn long"), 0.01).collect()


def test_time_to_detection(spark):
    items = [dict(ts=i * 1000, score=9.0 if i >= 3 else 0.0, label=1, scenario_id="burst", amount_paise=5000) for i in range(10)] + [dict(ts=50_000 + i, score=0.0, label=1, scenario_id="slow_low") for i in range(5)]
    windows = spark.createDataFrame([("burst", 0, 9000), ("slow_low", 50_000, 50_004), ("flash_sale", 0, 9000)], "scenario_id string, start_ms long, end_ms long")
    got = {r.scenario_id: r for r in metrics.time_to_detection(rows_of(spark, items), 5.0, windows).collect()}
    assert set(got) == {"burst", "slow_low"}
    assert (got["burst"].episodes, got["burst"].missed, got["burst"].median_events, got["burst"].median_rupees) == (1, 0, 3.0, 150.0)
    assert (got["slow_low"].missed, got["slow_low"].median_events) == (1, math.inf)


def recount_triage(items, threshold, c):
    held, last, until, out = [], {}, {}, {}
    for i, r in enumerate(items):
        k = (r["merchant_id"], r["bin"])
        held.append((k, r["ts"], r["card_ref"]))
        if r["score"] <= threshold:
            continue
        trail = [card for kk, ts, card in held if kk == k and ts >= r["ts"] - c.trailing_ms]
        ratio = round(len(trail) / len(set(trail)), 4)
        new = k not in last or r["ts"] - last[k] > c.dedup_cooldown_ms
        last[k] = r["ts"]
        tripped = r["ts"] < until.get(k, -1)
        now = not tripped and len(trail) >= c.min_events and ratio >= c.retry_ratio
        if now:
            until[k] = r["ts"] + c.kill_cooldown_ms
        inline = c.mode == "inline" and not (tripped or now)
        out[i] = (ratio, tripped or now, now, new, "decline" if inline else "alert" if new else "alert_dedup")
    return out


@pytest.mark.parametrize("mode", ["inline", "alert_only"])
def test_triage_is_a_recount(spark, mode):
    items = [dict(r, card_ref=f"c{i % 7}") for i, r in enumerate(sample(spark, 500))]
    c = TriageConfig(mode=mode, dedup_cooldown_ms=15 * MIN, trailing_ms=60 * MIN, retry_ratio=1.3, min_events=4, kill_cooldown_ms=45 * MIN)
    routed = triage.route(rows_of(spark, items), 4.0, c)
    got = {r.seq: (r.retry_ratio, r.tripped, r.tripped_now, r.new_alert, r.decision) for r in routed.collect()}
    want = recount_triage(items, 4.0, c)
    assert got == want and len({v[4] for v in want.values()}) >= 2
    trail = triage.audit(routed).orderBy("txn_id", "step").collect()
    assert len(trail) == 8 * len(want)
    for r in trail:
        assert (r.decision == "") == (r.step < 3) and (r.mode == "") == (r.step < 3) and (r.retry_ratio == 0.0 or r.step >= 2)
    halted = triage.audit(triage.route(rows_of(spark, items), 4.0, TriageConfig(mode="alert_only"), interrupt=True))
    assert halted.count() == 5 * len(want) and halted.filter("node = 'explain'").count() == 0


def test_topology():
    assert graph.check() == sorted(graph.SUCCESSORS)
    assert graph.walk("decline", False)[4] == "act" and graph.walk("alert", True)[-1] == "human_review"
    for bad in ({**graph.SUCCESSORS, "ground": ("act",)}, {**graph.SUCCESSORS, "lost": (graph.END,)}, {**graph.SUCCESSORS, "template": ("ground",), "ground": ("template",)}, {**graph.SUCCESSORS, "mode": ("nowhere",)}):
        with pytest.raises(graph.BadTopology):
            graph.check(bad)
    assert graph.mermaid().count("-->") == sum(map(len, graph.SUCCESSORS.values()))


def test_splits(spark):
    df = spark.range(100).selectExpr("id as seq", "id * 1000 as ts")
    train, test = df.filter("ts < 60000"), df.filter("ts >= 60000")
    splits.verify(train, test)
    for a, b in ((train, test.limit(0)), (test, train), (train.withColumn("ts", F.when(F.col("seq") == 30, 0).otherwise(F.col("ts"))), test)):
        with pytest.raises(splits.NonTemporalSplit):
            splits.verify(a, b)


@pytest.mark.parametrize("small", [50, 10**6])
def test_exact_quantile(spark, small):
    import numpy as np

    from tidemark.operators.quantiles import exact_quantile

    rng = np.random.default_rng(4)
    for values in (rng.normal(size=6000), np.round(rng.normal(size=4000)), np.repeat(1.5, 500), np.array([2.0]), rng.integers(0, 3, 999).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
        for q in (0.0, 0.25, 0.75, 0.9, 1.0):
            assert exact_quantile(df, "x", q, small) == pytest.approx(float(np.percentile(values, q * 100)), abs=1e-12)
    assert exact_quantile(df.limit(0), "x", 0.5) is None


def test_alert_intervals_are_a_recount(spark):
    """Of every event: the highest earlier score of its key within the cooldown, ties of time in stream order."""
    rng, t, items = random.Random(12), 0, []
    for i in range(400):
        t += rng.choice([0, 0, 1, 30, 99, 100, 101, 350])
        items.append(dict(ts=t - 5000, seq=i, merchant_id=f"m{rng.randrange(2)}", bin=f"{rng.randrange(2)}", score=float(rng.randrange(50)), label=0))
    df = spark.createDataFrame(items)
    for cooldown in (1, 100, 10**6):
        got = {r.seq: r.m for r in metrics.with_alert_interval(df, cooldown, "m").collect()}
        assert len(got) == len(items)
        for i, r in enumerate(items):
            past = [x["score"] for x in items[:i] if (x["merchant_id"], x["bin"]) == (r["merchant_id"], r["bin"]) and x["ts"] >= r["ts"] - cooldown]
            assert got[i] == max(past, default=float("-inf"))
        opened = metrics.alerts_per_day(df, 20.0, cooldown).first()["alerts"]
        assert opened == sum(r["score"] > 20.0 >= got[r["seq"]] for r in items) == metrics.alerts(df, 20.0, cooldown).count()
