"""Confusion, average precision, per-scenario rates, alerts, and time to detection.

Inputs are scored rows that carry ``score``, ``label``, ``scenario_id`` and the event's own
columns; a row is flagged if its score is above the threshold, not at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import ATTACKS, DAY_MS
from tidemark.operators.running import with_running_totals

INFINITY = float("inf")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` as IEEE 754 has it: what is divided by nought is infinite or not a number, not an error."""
    beyond = F.when(a > 0, F.lit(INFINITY)).when(a < 0, F.lit(-INFINITY)).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, beyond).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def confusion_columns(flagged: Column) -> list[Column]:
    bad = F.col("label") == 1
    return [F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"), F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn")]


def with_rates(confusion: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn)})


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    return with_rates(rows.agg(*confusion_columns(F.col("score") > threshold)))


def average_precision(rows: DataFrame) -> DataFrame:
    """Step-wise area: precision at each positive, ties in stream order."""
    ranked = with_running_totals(rows.select("score", "label", "seq"), [F.desc("score"), F.asc("seq")], {"tp": F.col("label").cast("long"), "rank": F.lit(1).cast("long")})
    hits = ranked.filter("label = 1").agg(F.sum(F.col("tp") / F.col("rank")).alias("s"), F.count(F.lit(1)).alias("p"))
    return hits.select(ratio(F.col("s"), F.col("p")).alias("average_precision"))


def per_scenario(rows: DataFrame, threshold: float) -> DataFrame:
    flagged = F.count_if(F.col("score") > threshold)
    grouped = rows.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("events"), flagged.alias("flagged"))
    return grouped.withColumns({"rate": F.col("flagged") / F.col("events"), "is_attack": F.col("scenario_id").isin(*ATTACKS)})


def _block(cooldown_ms: int) -> Column:
    """Blocks of time as long as the cooldown: flags of one key in a block are one alert's, whatever lies between them."""
    return F.floor(F.col("ts") / F.lit(max(cooldown_ms, 1))).cast("long")


def _pieces(flagged: DataFrame, cooldown_ms: int, *more: Column) -> DataFrame:
    """A row for each key and block of flags, with whether an alert begins there: what is ordered by key is blocks, not events."""
    found = flagged.groupBy("merchant_id", "bin", _block(cooldown_ms).alias("_block")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *more)
    own = Window.partitionBy("merchant_id", "bin").orderBy("_block")
    return found.withColumn("_opens", F.coalesce(F.col("first_ts") - F.lag("last_ts").over(own) > cooldown_ms, F.lit(True)))


def alerts(rows: DataFrame, threshold: float, cooldown_ms: int) -> DataFrame:
    """Flags of one (merchant, bin) with no gap over the cooldown are one alert."""
    pieces = _pieces(rows.filter(F.col("score") > threshold), cooldown_ms, F.count(F.lit(1)).alias("events"), F.max("score").alias("max_score"), F.sum("label").alias("_bad"))
    own = Window.partitionBy("merchant_id", "bin").orderBy("_block")
    numbered = pieces.withColumn("_run", F.sum(F.col("_opens").cast("int")).over(own))
    return numbered.groupBy("merchant_id", "bin", "_run").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"), F.max("max_score").alias("max_score"), (F.sum("_bad") > 0).alias("is_true")
    ).drop("_run")


def span_days(rows: DataFrame) -> Column:
    return F.greatest((F.max("ts") - F.min("ts")) / float(DAY_MS), F.lit(1e-9))


def alerts_per_day(rows: DataFrame, threshold: float, cooldown_ms: int) -> DataFrame:
    opened = _pieces(rows.filter(F.col("score") > threshold), cooldown_ms).agg(F.count_if("_opens").alias("alerts"))
    days = rows.agg(span_days(rows).alias("days"))
    # two rows of one each
    return opened.join(F.broadcast(days)).select("alerts", ratio(F.col("alerts").cast("double"), F.col("days")).alias("alerts_per_day"))


def with_alert_interval(rows: DataFrame, cooldown_ms: int, name: str) -> DataFrame:
    """``rows`` with the highest score that would have kept each from opening an alert.

    A flagged event opens an alert unless an earlier event of its key within the cooldown is
    flagged too, so it does at exactly the thresholds from this value up to below its own score.

    Time is cut into blocks as long as the cooldown.  What lies within it before an event is a beginning of its own block
    and an end of the block before; both are running maxima, and the second is asked for by a row sent to that block.  No task
    has more of a key than a block, and no frame slides.
    """
    columns = rows.columns
    block = ["merchant_id", "bin", "_block"]
    lowest = F.lit(-INFINITY)
    ahead = Window.partitionBy(*block).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_block", _block(cooldown_ms)).withColumn("_own", F.coalesce(F.max("score").over(ahead), lowest))
    both = own.withColumn("_asks", F.explode(F.array(F.lit(False), F.lit(True))))
    asks = F.col("_asks")
    sent = both.select(
        "merchant_id", "bin", asks, (F.col("_block") - asks.cast("long")).alias("_block"),
        (F.col("ts") - F.when(asks, cooldown_ms).otherwise(0)).alias("_at"), F.when(~asks, F.col("score")).alias("_score"),
        *[F.when(asks, F.col(c)).alias(c) for c in columns if c not in block], F.when(asks, F.col("_own")).alias("_own"),
    )
    behind = Window.partitionBy(*block).orderBy(F.desc("_at"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    told = sent.withColumn("_end", F.coalesce(F.max("_score").over(behind), lowest)).filter(asks)
    return told.select(*columns, F.greatest("_own", "_end").alias(name))


def time_to_detection(rows: DataFrame, threshold: float, episodes: DataFrame) -> DataFrame:
    """Per attack scenario: episodes, missed, and what went by before the first flag.

    ``episodes`` (scenario_id, start_ms, end_ms; ends included) is a small schedule, joined on
    the scenario and the range; Spark broadcasts it below its own size threshold.
    """
    windows = episodes.filter(F.col("scenario_id").isin(*ATTACKS)).withColumn("episode", F.concat_ws(":", "scenario_id", "start_ms", "end_ms"))
    inside = rows.join(windows, "scenario_id").filter("ts between start_ms and end_ms")
    order = Window.partitionBy("episode").orderBy("ts", "seq")
    ranked = inside.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_spent", F.coalesce(F.sum("amount_paise").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = F.col("score") > threshold
    first = ranked.groupBy("scenario_id", "episode").agg(F.min(F.when(hit, F.col("_rank"))).alias("events"), F.min(F.when(hit, F.struct("_rank", "_spent"))).getField("_spent").alias("spent"))
    found = first.withColumn("events", F.col("events").cast("double")).withColumn("rupees", F.col("spent") / 100.0)
    middle = {f"{name}_{stem}": F.coalesce(F.percentile(stem, F.lit(q)), F.lit(INFINITY)) for stem in ("events", "rupees") for name, q in (("median", 0.5), ("p90", 0.9))}
    return found.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("events").isNull()).alias("missed"), *[c.alias(n) for n, c in middle.items()])


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """By group, the values at index int(n * share) of the sorted values (latency reports).

    Equal values are counted before they meet, so what is ordered is one row per different value.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_up", F.sum("_c").over(up_to)).join(counted.groupBy(group).agg(F.sum("_c").alias("_n")), group)
    place = lambda q: F.least(F.floor(F.col("_n") * q).cast("long") + 1, F.col("_n"))
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("_up") >= place(q), F.col(value))).alias(name) for name, q in shares.items()])
