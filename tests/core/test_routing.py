"""Routing and reviews as streams, against batch."""

import random

import pytest
from pyspark.sql import functions as F

from tests.core.test_detector import events
from tidemark.model import TriageConfig
from tidemark.operators import triage
from tidemark.streaming import routing

CONFIG = TriageConfig(dedup_cooldown_ms=4_000, trailing_ms=20_000, retry_ratio=1.5, min_events=4, kill_cooldown_ms=15_000)


def scored(spark, n=900):
    rng = random.Random(8)
    rows = []
    for r in events(n, seed=4):
        # pauses after which a key's state has been dropped
        rows.append(dict(r, ts=10**9 + r["ts"] + 20_000_000 * (r["seq"] // 300), score=rng.random() * 4))
    return spark.createDataFrame(rows)


@pytest.mark.parametrize("batches", [1, 5])
def test_routing_stream_equals_batch(spark, batches):
    df = scored(spark)
    want = triage.route(df, 2.0, CONFIG, interrupt=True)
    got = routing.route_to_end(spark, df, 2.0, CONFIG, batches, interrupt=True)
    columns = ["seq", "trail_events", "trail_cards", "new_alert", "exposure_paise", "retry_ratio", "tripped", "tripped_now", "mode", "decision", "halted", "path", "score"]
    a, b = (x.select(*columns).orderBy("seq").collect() for x in (got, want))
    assert a == b and sum(r.tripped_now for r in a) > 5 and sum(not r.new_alert for r in a) > 50


def test_busy_keys_are_routed_in_stretches(spark):
    df = scored(spark)
    columns = ["seq", "trail_events", "trail_cards", "new_alert", "retry_ratio", "tripped", "tripped_now", "decision"]
    whole, cut = (triage.route(df, 1.0, CONFIG, hot=hot).select(*columns).orderBy("seq").collect() for hot in (10**9, 35))
    assert whole == cut and sum(r.tripped_now for r in whole) > 5


def test_reviews_resume_halted_walks(spark):
    rng = random.Random(2)
    flags = [(f"t{i}", 10_000_000 + i * 40_000) for i in range(60)]
    verdicts = [(t, ts + rng.randrange(-50_000, 900_000), rng.choice(["approve", "decline"])) for t, ts in flags for _ in range(rng.randrange(4))]
    verdicts += [("t3", flags[3][1], "approve"), ("t3", flags[3][1], "decline"), ("nobody", 10_500_000, "approve")]
    f = spark.createDataFrame(flags, "txn_id string, ts long")
    v = spark.createDataFrame(verdicts, "txn_id string, ts long, verdict string")
    want = {}
    for t, ts in flags:
        fits = sorted((at, what) for x, at, what in verdicts if x == t and ts <= at < ts + 600_000)
        want[t] = (ts, *fits[0]) if fits else (ts, ts + 600_000, routing.EXPIRED)
    batch = {r.txn_id: (r.flag_ts, r.resumed_ts, r.verdict) for r in routing.resumed(f, v, 600_000).collect()}
    assert batch == want and {w[2] for w in want.values()} == {"approve", "decline", "expired"}
    stream = routing.resume_to_end(spark, f, v, 600_000, batches=4).collect()
    assert len(stream) == len(flags) and {r.txn_id: (r.flag_ts, r.resumed_ts, r.verdict) for r in stream} == want


def test_a_micro_batch_that_runs_again_changes_nothing(spark, tmp_path):
    from tests.core.test_detector import CONFIG as detector
    from tidemark.operators import score
    from tidemark.streaming import scoring

    config = detector.with_(use_ewma=False)
    df = spark.createDataFrame([dict(r) for r in events(400)])
    folded = score.stretches.written(score.fold(df, config.with_(use_ewma=True)), "folded")
    run = scoring._unkeyed_batch(str(tmp_path), config)
    middle = folded.agg(F.percentile("ts", F.lit(0.5))).first()[0]
    parts = [folded.filter(F.col("ts") < middle), folded.filter(F.col("ts") >= middle)]
    for k in (0, 1, 1):  # the second one is run twice
        run(parts[k], k)
    got = {r.seq: r.score for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got == {r.seq: r.score for r in score.scored(df, config).collect()}
    run(folded.limit(0), 2)
    assert spark.read.parquet(f"{tmp_path}/baseline/n=2").collect() == spark.read.parquet(f"{tmp_path}/baseline/n=1").collect()


def test_the_unkeyed_baseline_of_a_micro_batch_is_planned_adaptively(spark, monkeypatch):
    from tests.core.test_detector import CONFIG as detector
    from tidemark.operators import stretches
    from tidemark.streaming import scoring

    adaptive, put = [], stretches.with_unkeyed_baseline
    monkeypatch.setattr(stretches, "with_unkeyed_baseline", lambda rows, *a, **k: adaptive.append(rows.sparkSession.conf.get("spark.sql.adaptive.enabled")) or put(rows, *a, **k))
    base = dict(merchant_id="m", bin="000001", card_ref="c", ip="192.0.2.1", device_id="d", amount_paise=1, status="approved")
    df = spark.createDataFrame([dict(base, txn_id=f"t{i}", seq=i, ts=1000 * i) for i in range(20)])
    found = scoring.run_to_end(spark, df, detector.with_(use_ewma=False))
    assert found.count() == 20 and adaptive == ["true", "true"]
