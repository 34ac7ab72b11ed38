"""Variants of the detector over seeds and budgets, their spread, and agreement of two scorings."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import EVENT_SCHEMA, FEATURE_COLUMNS, CostModel, DetectorConfig
from tidemark.operators import costs, metrics, score, splits, sweep
from tidemark.session import written
from tidemark.sources import files, generator

FIXTURE_SCHEMA = T.StructType([*(f for f in EVENT_SCHEMA.fields if f.name in FEATURE_COLUMNS), T.StructField("seq", T.LongType()), T.StructField("expected_score", T.DoubleType())])

#: Ways to score a stored stream; all give the same numbers.
STRATEGIES = {"fold": lambda spark, events, config: score.scored(events, config)}


def make_scorer(name: str):
    """The scorer of that name: (spark, events, config) to scored rows."""
    if name == "streaming":
        from tidemark.streaming.scoring import run_to_end

        return run_to_end
    if name not in STRATEGIES:
        raise ValueError(f"unknown scorer {name!r}; there are {sorted([*STRATEGIES, 'streaming'])}")
    return STRATEGIES[name]


def operating_point(events: DataFrame, boundary: int, config: DetectorConfig, model: CostModel, cooldown_ms: int, budget: float | None, validation_share: float = 0.25) -> DataFrame:
    """One row: the threshold chosen on validation, and what it does on the test window.

    The choice is made by a query that sees validation rows alone; its literal enters the second.
    """
    rows = written(score.scored(events, config, ["label", "scenario_id"]), "scored")
    first, end = rows.filter(F.col("ts") < boundary).agg(F.min("ts"), F.max("ts")).first()
    start = first + int((end - first) * (1.0 - validation_share))
    validation, test = (rows.filter(splits.split_name(start, boundary) == n) for n in ("validation", "test"))
    chosen = sweep.select_thresholds(sweep.threshold_sweep(validation, model, cooldown_ms), [budget]).first()
    at = float(chosen["threshold"])
    n = metrics.alerts_per_day(test, at, cooldown_ms).first()
    priced = costs.cost_breakdown(test, at, model, n["alerts"])
    counted = metrics.confusion(test, at).join(F.broadcast(metrics.average_precision(test))).join(F.broadcast(priced.select("net_paise", "alerts")))  # one row each
    return counted.select(F.lit(at).alias("threshold"), F.lit(bool(chosen["infeasible"])).alias("infeasible"), "precision", "recall", "average_precision", "net_paise", "alerts", F.lit(float(n["alerts_per_day"])).alias("alerts_per_day"))


def seed_matrix(spark: SparkSession, base: generator.StreamConfig, seeds: int, config: DetectorConfig, model: CostModel, cooldown_ms: int, budget: float | None) -> DataFrame:
    """A row for each seed and variant, each stream drawn anew."""
    parts = []
    for stream_config in generator.seeds(base, seeds):
        events = written(generator.stream(spark, stream_config), "stream")
        for name, variant in score.variants(config).items():
            point = operating_point(events, generator.boundary_ms(stream_config), variant, model, cooldown_ms, budget)
            parts.append(point.select(F.lit(stream_config.seed).alias("seed"), F.lit(name).alias("variant"), "*"))
    return reduce(DataFrame.unionByName, parts)


def spread(matrix: DataFrame, measure: str) -> DataFrame:
    """Least, median and most of a measure by variant."""
    return matrix.groupBy("variant").agg(F.min(measure).alias("least"), F.percentile(measure, F.lit(0.5)).alias("median"), F.max(measure).alias("most"))


def against_full(matrix: DataFrame, measure: str) -> DataFrame:
    """By variant: paired differences from the full detector, wins, and whether all seeds agree."""
    full = matrix.filter("variant = 'full'").select("seed", F.col(measure).alias("_full"))
    paired = matrix.filter("variant <> 'full'").join(full, "seed").withColumn("d", F.col(measure) - F.col("_full"))
    wins, n = F.count_if(F.col("d") > 0), F.count(F.lit(1))
    return paired.groupBy("variant").agg(F.min("d").alias("least"), F.max("d").alias("most"), wins.alias("wins"), n.alias("seeds"), ((wins == 0) | (wins == n)).alias("consistent"))


def write_parity(spark: SparkSession, path: str, events: DataFrame, config: DetectorConfig, tolerance: float = 1e-9) -> int:
    """A fixture of events and their scores: a table at ``path``, and its head (settings, tolerance) beside it; the rows."""
    scores = score.scored(events, config).select("txn_id", F.col("score").alias("expected_score"))
    rows = events.select(*FEATURE_COLUMNS, "seq").join(scores, "txn_id").repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq")
    rows.write.mode("overwrite").json(f"{path}/rows")
    files.write_json(spark, {"config": asdict(config), "tolerance": tolerance, "columns": list(FEATURE_COLUMNS)}, f"{path}/head")
    return spark.read.json(f"{path}/rows").count()


def check_parity(spark: SparkSession, path: str, scorer: str = "fold") -> DataFrame:
    """``parity`` of a fixture's scores and those that ``scorer`` gives its events now."""
    head = files.read_json(spark, f"{path}/head")
    config = DetectorConfig(**head["config"])
    rows = spark.read.schema(FIXTURE_SCHEMA).json(f"{path}/rows")
    again = make_scorer(scorer)(spark, rows.drop("expected_score"), config)
    return parity(rows.select("txn_id", F.col("expected_score").alias("score")), again, tolerance=head["tolerance"])


def parity(a: DataFrame, b: DataFrame, key: str = "txn_id", value: str = "score", tolerance: float = 1e-9) -> DataFrame:
    """One row: rows of each side alone, the largest difference, and whether the sides agree."""
    both = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    worst = F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0))
    only_a, only_b = F.count_if(F.col("_b").isNull()), F.count_if(F.col("_a").isNull())
    return both.agg(F.count(F.lit(1)).alias("n"), only_a.alias("only_a"), only_b.alias("only_b"), worst.alias("max_delta"), ((only_a == 0) & (only_b == 0) & (worst <= tolerance)).alias("equal"))
