"""Command line: generate, evaluate, replay, triage, parity, cassettes, graph.  Reads and writes through Spark."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found:
        return found
    from tidemark.session import local_session

    return local_session()


def generate(args, spark) -> int:
    from tidemark.operators import splits
    from tidemark.sources import files, generator

    config = generator.StreamConfig(seed=args.seed, total_days=args.days, train_days=args.days // 2)
    events = generator.stream(spark, config).cache()
    at = generator.boundary_ms(config)
    for name, part in (("train", events.filter(F.col("ts") < at)), ("test", events.filter(F.col("ts") >= at))):
        files.write_stream(part, f"{args.data}/{name}")
    summary = splits.summary(events.withColumn("split", F.when(F.col("ts") < at, "train").otherwise("test")), ["split"])
    episodes = spark.createDataFrame(generator.windows(generator.schedule(config)), "scenario_id string, start_ms long, end_ms long")
    files.write_json(spark, files.manifest(summary, episodes, config), f"{args.data}/manifest")
    summary.select("split", "n_rows", "positives").show()
    return 0


def _load(args, spark):
    from tidemark.operators import splits
    from tidemark.sources import files

    train, test = (files.read_stream(spark, f"{args.data}/{n}") for n in ("train", "test"))
    rows = [df.withColumn("seq", F.regexp_extract("txn_id", r"(\d+)$", 1).cast("long")) for df in (train, test)]
    splits.verify(*rows)
    return rows[0].unionByName(rows[1]), rows[1].agg(F.min("ts")).first()[0]


def evaluate(args, spark) -> int:
    from tidemark.model import CostModel, DetectorConfig
    from tidemark.operators import ablation

    events, boundary = _load(args, spark)
    ablation.operating_point(events, boundary, DetectorConfig(), CostModel(), 900_000, args.budget).show(truncate=False)
    return 0


def replay(args, spark) -> int:
    """Flags of the test window, warmed on training; a threshold must be given."""
    from tidemark.model import DetectorConfig
    from tidemark.operators import score
    from tidemark.sources import files

    if args.threshold is None:
        print("a threshold is required: the default is a placeholder")
        return 2
    events, boundary = _load(args, spark)
    rows = score.scored(events, DetectorConfig(), ["label", "scenario_id"]).filter(F.col("ts") >= boundary)
    flags = score.flags(rows, args.threshold)
    shown = files.suppress_repeats(flags).orderBy("ts", "seq")
    shown.select("ts", "txn_id", "merchant_id", "bin", F.round("score", 2).alias("score"), "scenario_id").show(args.limit, truncate=False)
    flags.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("flags"), F.sum("label").alias("true_flags")).orderBy(F.desc("flags")).show()
    return 0


def route(args, spark) -> int:
    from tidemark.model import DetectorConfig, TriageConfig
    from tidemark.operators import score, triage
    from tidemark.sources import files

    events, boundary = _load(args, spark)
    test = score.scored(events, DetectorConfig(), ["label", "scenario_id"]).filter(F.col("ts") >= boundary)
    routed = triage.route(test, args.threshold, TriageConfig(mode=args.mode))
    if args.audit:
        files.write_audit(triage.audit(routed), args.audit)
    triage.comparison(triage.with_decisions(test, routed), args.threshold).show()
    return 0


def parity(args, spark) -> int:
    """Write the fixture of scored events, or with --check score it again: 1 if it no longer holds."""
    from tidemark.model import DetectorConfig
    from tidemark.operators import ablation

    if args.check:
        found = ablation.check_parity(spark, args.data, args.scorer).first()
        print(f"{found['n']} events, largest difference {found['max_delta']:g}")
        return 0 if found["equal"] else 1
    events, _ = _load(args, spark)
    print(f"{ablation.write_parity(spark, args.out, events, DetectorConfig())} events")
    return 0


def cassettes(args, spark) -> int:
    """Judge recorded notes from their own files: 1 if one is rejected."""
    from tidemark.functions import grounding
    from tidemark.sources import files

    tapes = files.read_cassettes(spark, args.data)
    judged = grounding.verdicts(tapes.select("key", "model", F.col("response_text").alias("note"), "prompt"))
    for row in grounding.cassette_report(judged).toLocalIterator():
        print(row["text"])
    return 1 if judged.filter("not grounded").limit(1).count() else 0


def graph(args, spark) -> int:
    from tidemark.operators.graph import check, mermaid

    check()
    print(mermaid())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("generate", generate), ("evaluate", evaluate), ("replay", replay), ("triage", route), ("parity", parity), ("cassettes", cassettes), ("graph", graph)):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        if name != "graph":
            sub.add_argument("--data", required=True)
        if name == "generate":
            sub.add_argument("--seed", type=int, default=20_260_824)
            sub.add_argument("--days", type=int, default=100)
        if name == "evaluate":
            sub.add_argument("--budget", type=float, default=10.0)
        if name == "parity":
            sub.add_argument("--out")
            sub.add_argument("--check", action="store_true")
            sub.add_argument("--scorer", default="fold")
        if name in ("replay", "triage"):
            sub.add_argument("--threshold", type=float, required=name == "triage")
        if name == "replay":
            sub.add_argument("--limit", type=int, default=20)
        if name == "triage":
            sub.add_argument("--mode", choices=["inline", "alert_only"], default="inline")
            sub.add_argument("--audit")
    args = parser.parse_args(argv)
    return args.run(args, None if args.command == "graph" else _session())


if __name__ == "__main__":
    raise SystemExit(main())
