import json

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.model import CostModel, DetectorConfig
from tidemark.operators import ablation, score
from tidemark.sources import files, generator
from tidemark.streaming import scoring

TINY = generator.StreamConfig(seed=9, total_days=2, train_days=1, merchants=2, hourly_rate=(6.0, 8.0), cards=300, ips=200, devices=200, bins=12)


def test_seed_matrix(spark):
    matrix = ablation.seed_matrix(spark, TINY, 2, DetectorConfig(), CostModel(), 900_000, 10.0).cache()
    rows = matrix.collect()
    assert {(r.seed, r.variant) for r in rows} == {(s, v) for s in (9, 10) for v in ("full", "drop_ewma", "drop_ip")}
    assert all(0 <= r.recall <= 1 and r.alerts >= 0 for r in rows)
    assert ablation.spread(matrix, "recall").count() == 3
    pairs = {r.variant: r for r in ablation.against_full(matrix, "net_paise").collect()}
    assert set(pairs) == {"drop_ewma", "drop_ip"} and all(r.seeds == 2 for r in pairs.values())


def test_choice_sees_validation_only(spark):
    events = generator.stream(spark, TINY).cache()
    at = generator.boundary_ms(TINY)
    args = (at, DetectorConfig(), CostModel(), 900_000, 10.0)
    poisoned = events.withColumn("label", F.when(F.col("ts") >= at, 1 - F.col("label")).otherwise(F.col("label")))
    assert ablation.operating_point(events, *args).first().threshold == ablation.operating_point(poisoned, *args).first().threshold


def test_scorers(spark):
    events = files.by_stream_order(generator.stream(spark, TINY), 300)
    a = ablation.make_scorer("fold")(spark, events, DetectorConfig())
    b = ablation.make_scorer("streaming")(spark, events, DetectorConfig())
    assert ablation.parity(a, b).first().equal
    assert not ablation.parity(a, b.limit(299)).first().equal
    with pytest.raises(ValueError):
        ablation.make_scorer("other")


def test_streaming_keeps_every_row(spark):
    """An input whose rows differ from one evaluation to the next is read once."""
    events = generator.stream(spark, TINY).withColumn("ts", F.col("ts") + (F.rand() * 86_400_000 * 30).cast("long")).limit(200)
    out = ablation.make_scorer("streaming")(spark, events, DetectorConfig())
    assert out.count() == 200


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(generator, "StreamConfig", lambda **k: TINY)
    data = str(tmp_path / "d")
    assert main(["generate", "--data", data]) == 0
    assert files.read_json(spark, f"{data}/manifest")["parameters"]["merchants"] == 2
    assert main(["evaluate", "--data", data, "--budget", "20"]) == 0
    assert main(["replay", "--data", data]) == 2
    assert main(["replay", "--data", data, "--threshold", "8"]) == 0
    assert main(["triage", "--data", data, "--threshold", "8", "--audit", str(tmp_path / "audit")]) == 0
    assert spark.read.json(str(tmp_path / "audit")).groupBy("node").count().count() >= 8
    assert main(["parity", "--data", data, "--out", str(tmp_path / "fixture")]) == 0
    assert main(["parity", "--data", str(tmp_path / "fixture"), "--check"]) == 0
    head = files.read_json(spark, str(tmp_path / "fixture" / "head"))
    head["config"]["w_decline_bin"] += 1.0
    files.write_json(spark, head, str(tmp_path / "fixture" / "head"))
    assert main(["parity", "--data", str(tmp_path / "fixture"), "--check"]) == 1
    (tmp_path / "tapes").mkdir()
    for key, note in (("a", "Rs 5 it was"), ("b", "The AVS failed at Rs 5.")):
        (tmp_path / "tapes" / f"{key}.json").write_text(json.dumps({"key": key, "model": "m", "prompt": "amount Rs 5.00", "response_text": note}))
    assert main(["cassettes", "--data", str(tmp_path / "tapes")]) == 1
    shown = capsys.readouterr().out
    assert "1 of 2 rejected" in shown and "no address match is among the evidence" in shown
    assert main(["graph"]) == 0
    assert "flowchart" in capsys.readouterr().out


def test_event_time_reports(spark, tmp_path):
    base = 1_767_225_600_000
    rows = [(base + 60_000 * i, f"t{i % 50}", "m", "000001", f"c{i % 5}", 100, "declined" if i % 4 == 0 else "approved", 9.0) for i in range(60)]
    schema = "ts long, txn_id string, merchant_id string, bin string, card_ref string, amount_paise long, status string, score double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def drain(transform, name, mode="complete"):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    report = drain(lambda s: scoring.windowed_report(s, "30 minutes"), "report")
    assert sorted((r.events, r.declines) for r in report) == [(30, 7), (30, 8)]
    assert len(drain(scoring.deduplicated, "once", "append")) == 50
    sessions = drain(lambda s: scoring.alert_sessions(s.filter("minute(timestamp_millis(ts)) < 10 or minute(timestamp_millis(ts)) > 40"), 900_000), "sessions")
    assert sorted(r.events for r in sessions) == [10, 19]


def test_score_plan_has_two_exchanges_and_no_join(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from tidemark.sources.adapter import read_events

    plan = score.scored(read_events(spark, "/root/testdata/sf0.001"), DetectorConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and events.count()
