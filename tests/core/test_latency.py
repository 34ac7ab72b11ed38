"""Measured waiting times, and sketches against exact ranks."""

import random

from pyspark.sql import functions as F

from tests.core.test_detector import CONFIG, events
from tidemark.streaming import latency, scoring


def test_percentiles_of_measured_batches(spark):
    queries = []
    scoring.run_to_end(spark, spark.createDataFrame([dict(r) for r in events(300)]), CONFIG.with_(use_per_ip=False), batches=2, queries=queries)
    batches = latency.measured(spark, queries)
    rows = batches.collect()
    assert len(queries) == 2 and sum(r.events for r in rows) == 300
    waits = sorted(r.total_ms for r in rows for _ in range(r.events))
    got = latency.percentiles(batches).first()
    assert (got.p50_ms, got.p95_ms, got.p99_ms) == tuple(waits[int(300 * q)] for q in (0.5, 0.95, 0.99))
    assert got.events == 300 and got.events_per_sec > 0
    none = latency.percentiles(batches.limit(0)).first()
    assert none.p50_ms is None


def test_merged_sketches_keep_their_bound(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(3, 2) for _ in range(40_000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "part int, v double")
    got = latency.merged(latency.sketches(df, ["part"], "v").withColumn("all", F.lit(1)), ["all"]).first()
    assert got.n == len(values)
    values.sort()
    for name, q in latency.SHARES.items():
        rank = sum(v <= got[name] for v in values) / len(values)
        assert abs(rank - q) <= latency.RANK_ERROR
