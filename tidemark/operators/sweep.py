"""All thresholds of a grid at once, and the choice among them.

A row is flagged at the grid points below its score, which are a prefix of the grid; it opens an
alert at the points of an interval (``metrics.with_alert_interval``).  So every count over the grid is
a sum over one bucket number per row: one aggregation to at most ``points`` rows and running
sums over those, however many events there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import CostModel
from tidemark.operators.costs import basis, priced
from tidemark.operators.metrics import ratio, span_days, with_alert_interval
from tidemark.operators.quantiles import exact_quantile
from tidemark.session import written

POINTS, BAND = 600, 0.05


def grid(lo: Column, hi: Column, k: Column, points: int = POINTS) -> Column:
    """Point k of evenly spaced ones; the last is exactly ``hi``."""
    return F.when(k >= points - 1, hi).otherwise(lo + k * ((hi - lo) / (points - 1)))


def points_below(score: Column, lo: Column, hi: Column, points: int = POINTS) -> Column:
    """How many grid points are strictly below ``score``."""
    near = F.coalesce(F.floor(F.try_divide(score - lo, (hi - lo) / (points - 1))), F.when(score > lo, points).otherwise(0))
    first = F.greatest(F.lit(0).cast("long"), F.least(F.lit(points).cast("long"), near.cast("long")) - 1)
    steps = [F.when((first + i < points) & (grid(lo, hi, first + i, points) < score), 1).otherwise(0) for i in range(3)]
    return F.when(score == F.lit(float("-inf")), 0).otherwise(first + steps[0] + steps[1] + steps[2]).cast("int")


def threshold_sweep(rows: DataFrame, model: CostModel, cooldown_ms: int, points: int = POINTS) -> DataFrame:
    """One row per grid point from the 75th percentile to the maximum of the scores."""
    # read several times below, and scored once
    rows = written(rows.select("score", "label", "status", "amount_paise", "merchant_id", "bin", "ts", "seq"), "sweep-rows")
    lo = exact_quantile(rows, "score", 0.75)
    ends = rows.agg(
        F.lit(lo).cast("double").alias("lo"), F.max("score").alias("hi"), span_days(rows).alias("days"),
        F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"),
    )
    # ``ends`` is one row: joined everywhere by broadcast
    above = rows.join(F.broadcast(ends.select("lo", "hi"))).filter("score > lo")
    opened = with_alert_interval(above, cooldown_ms, "_m")
    bucketed = opened.select("*", points_below(F.col("score"), F.col("lo"), F.col("hi"), points).alias("_to")).withColumn("_from", F.least(points_below(F.col("_m"), F.col("lo"), F.col("hi"), points), F.col("_to")))
    flags = bucketed.groupBy(F.col("_to").alias("k")).agg(*basis(F.lit(True), model), F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    names = [c for c in flags.columns if c != "k"]
    edges = bucketed.select(F.explode(F.array(F.struct(F.col("_from").alias("k"), F.lit(1).alias("d")), F.struct(F.col("_to").alias("k"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    edges = edges.groupBy("k").agg(F.sum("d").alias("d"))
    every = rows.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("k"))
    table = every.join(flags, "k", "left").join(edges, "k", "left").na.fill(0)
    after = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = table.select("k", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in names], F.sum("d").over(up_to).alias("alerts")).filter(F.col("k") < points)
    out = sums.join(F.broadcast(ends)).withColumns(priced(model)).filter("hi is not null")
    return out.select(
        "k",
        grid(F.col("lo"), F.col("hi"), F.col("k"), points).alias("threshold"),
        "gross_paise",
        (F.col("gross_paise") - F.col("alerts") * float(model.review_paise)).alias("net_paise"),
        "alerts",
        (F.col("alerts") / F.col("days")).alias("alerts_per_day"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("bad")).alias("recall"),
        ratio(F.col("gross_paise"), F.col("alerts").cast("double")).alias("break_even_paise"),
    )


def select_thresholds(sweep: DataFrame, budgets: list[float | None]) -> DataFrame:
    """For each alert budget the chosen grid point; ``budget`` null is no budget.

    Within the budget the net position counts; points within 5 % of the best go to the lowest
    threshold, a best of nil or less to the first best point; with none in the budget, the
    quietest point is taken and marked.
    """
    wanted = sweep.sparkSession.createDataFrame([(None if b is None else float(b),) for b in budgets], "budget double")
    pairs = sweep.join(F.broadcast(wanted))  # a handful of budgets
    fits = F.col("budget").isNull() | (F.col("alerts_per_day") <= F.col("budget"))
    marked = pairs.withColumn("_fits", fits).withColumn("_best", F.max(F.when(fits, F.col("net_paise"))).over(Window.partitionBy("budget")))
    close = F.col("_fits") & (F.col("net_paise") >= F.col("_best") * (1.0 - BAND))
    turn = (
        F.when(F.col("_best").isNull(), F.struct(F.lit(0).alias("a"), F.col("alerts_per_day").alias("b"), F.col("k").alias("c")))
        .when(F.col("_best") <= 0, F.struct(F.when(F.col("_fits"), 0).otherwise(1).alias("a"), (-F.col("net_paise")).alias("b"), F.col("k").alias("c")))
        .otherwise(F.struct(F.when(close, 0).otherwise(1).alias("a"), F.lit(0.0).alias("b"), F.col("k").alias("c")))
    )
    first = marked.withColumn("_turn", F.row_number().over(Window.partitionBy("budget").orderBy(turn)))
    return first.filter("_turn = 1").withColumn("infeasible", F.col("_best").isNull()).drop("_turn", "_best", "_fits")
