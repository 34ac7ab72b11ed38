"""The detector against a plain recount of every event, and its metamorphic properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import TERMS, DetectorConfig
from tidemark.operators import score, stretches, windows
from tidemark.operators.fold import entity_fold

CONFIG = DetectorConfig(window_ms=10_000, ring_capacity=8, sample_interval_ms=3_000, min_samples=4, halflife_samples=3.0)


def events(n=1500, seed=1):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 400, 900, 2500, 10_000 if i % 97 == 0 else 300])
        out.append(dict(seq=i, ts=t, txn_id=f"t{i}", merchant_id=f"m{rng.randrange(3)}", bin=f"0{rng.randrange(4):05d}", card_ref=f"c{rng.randrange(12)}", ip=f"192.0.2.{rng.randrange(6)}", device_id="d", amount_paise=rng.randrange(100, 9000), status=rng.choice(["approved", "approved", "declined"]), label=rng.randrange(2), scenario_id="benign"))
    return out


def window(rows, axis, i, c):
    mine = [r for r in rows[: i + 1] if r[axis] == rows[i][axis]][-c.ring_capacity :]
    return [r for r in mine if r["ts"] > rows[i]["ts"] - c.window_ms]


def samples(rows, axis, i, c):
    """Indices of the baseline samples of row i's entity before row i."""
    out, last = [], None
    for j in range(i):
        if rows[j][axis] == rows[i][axis] and (last is None or rows[j]["ts"] - last >= c.sample_interval_ms):
            out.append(j)
            last = rows[j]["ts"]
    return out


def spread_of(x):
    mean = sum(x) / len(x) if x else 0.0
    return mean, math.sqrt(sum((v - mean) ** 2 for v in x) / (len(x) - 1)) if len(x) > 1 else 0.0


def recount(rows, i, c, all_samples):
    """Terms of row i out of the rows alone."""

    def z(axis):
        n = len(window(rows, axis, i, c))
        if c.use_ewma:
            counts = [len(window(rows, axis, j, c)) for j in samples(rows, axis, i, c)]
            centre = counts[0] if counts else 0.0
            for v in counts[1:]:
                centre += (1 - math.exp(-math.log(2) / c.halflife_samples)) * (v - centre)
        else:
            counts = [len(window(rows, "bin", j, c)) for j in all_samples if j < i]
            centre = spread_of(counts)[0]
        sd = spread_of(counts)[1]
        return max(0.0, (n - centre) / sd) if len(counts) >= c.min_samples and sd > 1e-9 else 0.0

    w, s = window(rows, "bin", i, c), [window(rows, "bin", j, c) for j in samples(rows, "bin", i, c)]
    known = len(s) >= c.min_samples
    warm = known or not c.use_ewma
    share = lambda x: sum(r["status"] == "declined" for r in x) / len(x)
    mean = lambda x: sum(r["amount_paise"] for r in x) / len(x)
    base_share = sum(map(share, s)) / len(s) if known else 0.0
    base_mean = sum(map(mean, s)) / len(s) if known else 0.0
    cards, merchants = len({r["card_ref"] for r in w}), len({r["merchant_id"] for r in w})
    retry = len(w) / cards - 1
    if c.long_window_ms:
        long = [r for r in rows[: i + 1] if r["bin"] == rows[i]["bin"] and r["ts"] > rows[i]["ts"] - c.long_window_ms]
        retry = c.w_long_repetition / c.w_repetition * (len(long) / len({r["card_ref"] for r in long}) - 1)
    return [
        c.w_velocity_bin * z("bin"), c.w_decline_bin * (max(0.0, share(w) - base_share) if warm else 0.0) * 10,
        c.w_amount * (max(0.0, math.log(base_mean / mean(w))) if warm and base_mean > 0 and mean(w) > 0 else 0.0),
        c.w_velocity_ip * (z("ip") if c.use_per_ip else 0.0), -c.w_repetition * retry, -c.w_merchant_span * (merchants - 1),
    ]


@pytest.mark.parametrize("config", [CONFIG, CONFIG.with_(use_ewma=False), CONFIG.with_(use_per_ip=False), CONFIG.with_(long_window_ms=40_000, w_long_repetition=6.0)])
def test_terms_are_a_recount(spark, config):
    rows = events(420)
    all_samples, last = [], None
    for j, r in enumerate(rows):
        if last is None or r["ts"] - last >= config.sample_interval_ms:
            all_samples.append(j)
            last = r["ts"]
    df = spark.createDataFrame([dict(r) for r in rows])
    got = {r.seq: r for r in score.scored(df.repartition(5), config).collect()}
    assert len(got) == len(rows)
    for i in range(0, len(rows), 3):
        want = recount(rows, i, config, all_samples)
        assert [got[i][t] for t in TERMS] == pytest.approx(want, abs=1e-9), i
        assert got[i].score == pytest.approx(sum(want), abs=1e-9)


def test_fold_equals_window_functions(spark):
    df = spark.createDataFrame([dict(r) for r in events()])
    a = score.scored(df, CONFIG)
    b = windows.entity_windows(df, "bin", CONFIG.window_ms, CONFIG.ring_capacity)
    c = windows.with_saturation(df, "bin", CONFIG.window_ms, CONFIG.ring_capacity).withColumn("n", windows.window_count("bin", CONFIG.window_ms, CONFIG.ring_capacity))
    j = a.join(b.select("seq", "window_amount", *[F.col(x).alias("b_" + x) for x in ("window_events", "window_declines", "window_cards", "window_merchants")]), "seq").join(c.select("seq", "n", F.col("window_saturated").alias("full")), "seq")
    wrong = j.filter("window_events <> b_window_events or window_events <> n or window_declines <> b_window_declines or window_distinct_cards <> b_window_cards or window_distinct_merchants <> b_window_merchants or window_saturated <> full")
    assert wrong.count() == 0
    assert j.filter("window_saturated").count() > 0 and j.count() == 1500


@pytest.mark.parametrize("hot", [60])
def test_hot_keys_in_stretches(spark, hot):
    """Keys cut into stretches of time have the numbers of keys that are not, to the last bit."""
    df = spark.createDataFrame(events())
    for detail in (True, False):
        whole = entity_fold(df, "bin", CONFIG, "bin", detail=detail)
        plan = stretches.prepared(df, "bin", CONFIG, detail, hot)
        assert plan.cut.cells.select(stretches.STRETCH).distinct().count() > 1
        split = stretches.split_fold(df, "bin", CONFIG, "bin", detail, plan)
        assert split.columns == whole.columns
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))
    for config in (CONFIG.with_(use_ewma=False),):
        a, b = (score.fold(df, config, hot=h).orderBy("seq").collect() for h in (hot, 10**9))
        assert a == b


def test_unkeyed_baseline_over_stretches(spark):
    df = spark.createDataFrame(events())
    folded = score.fold(df, CONFIG)
    config = CONFIG.with_(use_ewma=False)
    a, b = (score.with_global_baseline(folded, config, stretch).orderBy("seq").collect() for stretch in (40, 10**6))
    assert a == b and max(r.all_samples for r in a) > 50


def test_boundary_and_ties(spark):
    base = dict(merchant_id="m", bin="000001", card_ref="c", ip="192.0.2.1", device_id="d", amount_paise=1, status="approved", txn_id="t")
    df = spark.createDataFrame([dict(base, seq=i, ts=t) for i, t in enumerate([1000, 2000, 2000, 2999, 3000])])
    n = {r.seq: r.n for r in df.select("seq", windows.window_count("bin", 1000).alias("n")).collect()}
    assert n == {0: 1, 1: 1, 2: 2, 3: 3, 4: 2}  # exactly one window old is out; later peers don't count
    closed = {r.seq: r.t_events for r in windows.time_window_cards(df, ["bin"], 1000, True, "t").collect()}
    assert closed == {0: 1, 1: 2, 2: 3, 3: 3, 4: 4}


def test_labels_and_card_names_do_not_matter(spark):
    rows = events(600)
    df = spark.createDataFrame([dict(r) for r in rows])
    plain = {r.seq: r.score for r in score.scored(df, CONFIG).collect()}
    for changed in (df.withColumn("label", 1 - F.col("label")), df.withColumn("card_ref", F.sha2("card_ref", 256))):
        assert {r.seq: r.score for r in score.scored(changed, CONFIG).collect()} == plain
    plan = score.scored(df, CONFIG)._jdf.queryExecution().optimizedPlan().toString()
    assert "label" not in plan.split("LogicalRDD")[0].split("Relation")[0]


def test_flags_and_contributions(spark):
    rows = score.scored(spark.createDataFrame([dict(r) for r in events(600)]), CONFIG)
    top = rows.agg(F.max("score")).first()[0]
    assert score.flags(rows, top).count() == 0  # above, not at
    for r in score.flags(rows, 1.0).limit(50).collect():
        values = [abs(c.value) for c in r.contributions]
        assert values == sorted(values, reverse=True) and {c.term for c in r.contributions} == set(TERMS)
        assert sum(c.value for c in r.contributions) == pytest.approx(r.score)


@pytest.mark.parametrize("config", [CONFIG, CONFIG.with_(long_window_ms=40_000, w_long_repetition=6.0), CONFIG.with_(use_ewma=False, use_per_ip=False)])
def test_streaming_equals_batch(spark, config):
    from tidemark.streaming import scoring

    df = spark.createDataFrame([dict(r) for r in events(700)])
    want = {r.seq: r.score for r in score.scored(df, config).collect()}
    got = {r.seq: r.score for r in scoring.run_to_end(spark, df, config, batches=2).collect()}
    assert got == want and len(got) == 700


def test_variants_come_out_of_one_fold(spark, monkeypatch):
    df = spark.createDataFrame(events(120))
    configs = score.variants(CONFIG)
    want = {n: {r.seq: r.score for r in score.scored(df, c).collect()} for n, c in configs.items()}
    folds, whole = [], score.fold
    monkeypatch.setattr(score, "fold", lambda *args: folds.append(args) or whole(*args))
    found = score.variant_scores(df, configs).collect()
    assert len(folds) == 1 and {n: {r.seq: r[n] for r in found} for n in configs} == want
    with pytest.raises(ValueError):
        score.variant_scores(df, {"a": CONFIG, "b": CONFIG.with_(ring_capacity=3)})


def test_micro_batches_grow_in_number_not_in_rows(spark, monkeypatch):
    from tidemark.streaming import scoring

    monkeypatch.setattr(scoring, "BATCH_ROWS", 50)
    config, queries = CONFIG.with_(use_per_ip=False), []
    df = spark.createDataFrame(events(160))
    want = {r.seq: r.score for r in score.scored(df, config).collect()}
    got = {r.seq: r.score for r in scoring.run_to_end(spark, df, config, batches=2, queries=queries).collect()}
    assert got == want and len(queries) == -(-len(want) // 50) > 2
    assert max(p["numInputRows"] for q in queries for p in q.recentProgress) < len(want) / 2
