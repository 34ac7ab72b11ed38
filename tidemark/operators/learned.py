"""Learned baselines over the detector's terms, and comparisons of variants over seeds."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import hour_of_day
from tidemark.model import TERMS, CostModel, DetectorConfig
from tidemark.operators import boosting
from tidemark.operators.costs import cost_breakdown
from tidemark.operators.metrics import alerts_per_day, average_precision, confusion
from tidemark.operators.score import scored as scored_rows
from tidemark.operators.splits import split_name
from tidemark.operators.sweep import select_thresholds, threshold_sweep
from tidemark.session import written
from tidemark.sources import generator

EXTRA = ("log_amount", "declined", "hour")
#: Bins of a feature in Spark's trees, and rows from which on it samples their bounds.
BINS, SAMPLED = 32, 10_000


def features(rows: DataFrame) -> DataFrame:
    """Scored rows with the three columns of the event itself."""
    return rows.withColumns({"log_amount": F.log1p("amount_paise"), "declined": (F.col("status") == "declined").cast("double"), "hour": hour_of_day(F.col("ts"))})


def logreg(rows: DataFrame, strength: float = 1.0):
    """Standardised terms, penalised as a sum over rows (so by 1 / (C n) on the mean)."""
    n = max(rows.count(), 1)
    stages = [VectorAssembler(inputCols=list(TERMS), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True), LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / (strength * n), standardization=False, maxIter=200)]
    return Pipeline(stages=stages).fit(rows)


def bin_splits(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Splits of each column into at most ``bins`` bins, from all rows: between its values if they are few, else at quantiles, values of over a bin's weight being bins of their own."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    x = {c: F.col(c).cast("double") for c in columns}
    seen = rows.agg(*[F.approx_count_distinct(x[c], 0.02).alias(f"n_{c}") for c in columns], *[F.percentile_approx(x[c], shares, 10_000).alias(f"q_{c}") for c in columns]).first()
    # only of columns that have about as few values as bins are the values asked for
    few = [c for c in columns if seen[f"n_{c}"] <= 2 * bins]
    values = rows.agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(x[c])).alias(c) for c in few]).first()
    found = []
    for c in columns:
        if c in few and len(values[c]) <= bins:
            inner = [(a + b) / 2.0 for a, b in zip(values[c], values[c][1:])] or values[c]
        else:
            weight = Counter(seen[f"q_{c}"])
            inner = [*weight.keys() - {q for q in weight if weight[q] < 2}, *(math.nextafter(q, math.inf) for q in weight)]
        found.append([-math.inf, *sorted(set(inner)), math.inf])
    return found


def binned_groups(rows: DataFrame, columns: list[str], splits: list[list[float]]) -> tuple[Bucketizer, DataFrame]:
    """What bins ``columns``, and a row for each label and combination of bins, with the number of its rows as ``_weight``."""
    names = [f"_bin_{c}" for c in columns]
    binner = Bucketizer(inputCols=columns, outputCols=names, splitsArray=splits)
    # sums are without Bucketizer's note that bins are classes: trees are to cut between them in order
    return binner, binner.transform(rows).select("label", *[(F.col(c) + 0.0).alias(c) for c in names]).groupBy("label", *names).agg(F.count(F.lit(1)).cast("double").alias("_weight"))


def gbt(rows: DataFrame, trees: int = 200, seed: int = 7, sampled: int = SAMPLED):
    """Boosted trees on terms and event columns: 200 rounds of up to 32 leaves (five levels).

    Trees know rows by their bins alone.  Of over ``sampled`` rows Spark would sample the bins' bounds; here they are taken from all rows, and
    rows of equal bins and label, which have the same margin in every round, are one row that weighs as many.
    """
    columns = [*TERMS, *EXTRA]
    settings = dict(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=5, stepSize=0.1, seed=seed, cacheNodeIds=True, maxMemoryInMB=512)
    if rows.count() <= sampled:
        return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x"), GBTClassifier(**settings)]).fit(rows)
    binner, groups = binned_groups(rows, columns, bin_splits(rows, columns))
    groups = written(groups, "binned-groups")
    # bins are their own values: with bounds from all groups, each stays a bin
    whole = max(BINS, math.isqrt(groups.count()) + 1)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=binner.getOutputCols(), outputCol="x"), GBTClassifier(weightCol="_weight", maxBins=whole, **settings)]).fit(groups)
    return PipelineModel(stages=[binner, *fitted.stages])


def leafwise(rows: DataFrame, rounds: int = 200) -> boosting.Boosted:
    """Boosted leaf-wise trees on terms and event columns: rounds of 31 leaves at a rate of 0.1."""
    return boosting.fit(rows, [*TERMS, *EXTRA], rounds=rounds)


def weights(model) -> dict[str, float]:
    """Learned weight per unit of each term, as the hand-set ones are stated."""
    scale, fitted = model.stages[1], model.stages[2]
    return {t: float(w / s) if s else 0.0 for t, w, s in zip(TERMS, fitted.coefficients, scale.std)}


def decision(model, rows: DataFrame, name: str = "score") -> DataFrame:
    """Rows with the model's raw margin as their score."""
    if isinstance(model, boosting.Boosted):
        return model.margins(rows, name)
    kept = [c for c in rows.columns if c != name]
    return model.transform(rows.select(*kept)).select(*kept, vector_to_array("rawPrediction")[1].alias(name))


def evaluate(marked: DataFrame, kind: str, model: CostModel, cooldown_ms: int, budget: float | None, **settings) -> DataFrame:
    """Fit on warm-up, choose the threshold on validation by budget and net, count on test: one row.

    ``kind``: ``logreg``, ``gbt``, ``leafwise``, or ``hand``, the control that ranks by the detector's own score.
    """
    rows = written(features(marked), "learned-rows")
    if kind == "hand":
        scored = rows.filter("split <> 'warmup'")
    else:
        fitted = {"logreg": logreg, "gbt": gbt, "leafwise": leafwise}[kind](rows.filter("split = 'warmup'"), **settings)
        scored = written(decision(fitted, rows.filter("split <> 'warmup'")), "learned-scores")
    validation, test = (scored.filter(F.col("split") == n) for n in ("validation", "test"))
    chosen = select_thresholds(threshold_sweep(validation, model, cooldown_ms), [budget]).first()
    at = float(chosen["threshold"])
    n = alerts_per_day(test, at, cooldown_ms).first()
    priced = cost_breakdown(test, at, model, n["alerts"]).select("net_paise")
    out = confusion(test, at).join(F.broadcast(average_precision(test))).join(F.broadcast(priced))  # one row each
    rounded = [F.round(c, 4).alias(c) for c in ("precision", "recall", "average_precision")]
    return out.select(F.lit(kind).alias("model"), F.round(F.lit(at), 4).alias("threshold"), F.lit(bool(chosen["infeasible"])).alias("infeasible"), "tp", "fp", "fn", "tn", *rounded, F.round("net_paise", 2).alias("net_paise"), F.lit(int(n["alerts"])).alias("alerts"))


def seed_matrix(spark: SparkSession, base: generator.StreamConfig, seeds: int, config: DetectorConfig, model: CostModel, cooldown_ms: int, budget: float | None, kinds: tuple[str, ...] = ("hand", "logreg", "gbt"), validation_share: float = 0.25) -> DataFrame:
    """A row for each seed and model, each stream drawn anew."""
    parts = []
    for stream_config in generator.seeds(base, seeds):
        events = written(generator.stream(spark, stream_config), "stream")
        at = generator.boundary_ms(stream_config)
        first, end = events.filter(F.col("ts") < at).agg(F.min("ts"), F.max("ts")).first()
        start = first + int((end - first) * (1.0 - validation_share))
        marked = scored_rows(events, config, ["label", "scenario_id"]).withColumn("split", split_name(start, at))
        parts += [evaluate(marked, kind, model, cooldown_ms, budget).select(F.lit(stream_config.seed).alias("seed"), "*") for kind in kinds]
    return reduce(DataFrame.unionByName, parts)


def paired_spread(variant: DataFrame, base: DataFrame) -> DataFrame:
    """Differences by seed: least, median, most, wins, and whether all seeds agree."""
    joined = variant.withColumnRenamed("v", "a").join(base.withColumnRenamed("v", "b"), "seed").withColumn("d", F.col("a") - F.col("b"))
    wins = F.count_if(F.col("d") > 0)
    return joined.agg(F.min("d").alias("least"), F.percentile("d", F.lit(0.5)).alias("median"), F.max("d").alias("most"), wins.alias("wins"), F.count(F.lit(1)).alias("n"), ((wins == 0) | (wins == F.count(F.lit(1)))).alias("consistent"))
