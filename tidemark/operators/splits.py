"""Temporal splits and what the streams hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import SCENARIOS


class NonTemporalSplit(ValueError):
    """The test window doesn't lie wholly after the training window."""


def boundaries(events: DataFrame, train_share: float = 2 / 3, validation_share: float = 0.25) -> tuple[int, int]:
    """(first ms of validation, first ms of test), by shares of the time span, truncated."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    test = first + int((last - first) * train_share)
    end = events.filter(F.col("ts") < test).agg(F.max("ts")).first()[0]
    return first + int(((end if end is not None else first) - first) * (1.0 - validation_share)), test


def split_name(validation_start: int, boundary: int) -> Column:
    return F.when(F.col("ts") >= boundary, "test").when(F.col("ts") >= validation_start, "validation").otherwise("warmup")


def verify(train: DataFrame, test: DataFrame) -> None:
    """Raise unless both windows have rows, in time order, and one ends before the other starts."""
    ends = [df.agg(F.min("ts"), F.max("ts")).first() for df in (train, test)]
    if ends[0][0] is None or ends[1][0] is None:
        raise NonTemporalSplit("a window is empty")
    if ends[0][1] >= ends[1][0]:
        raise NonTemporalSplit(f"training ends at {ends[0][1]}, the test starts at {ends[1][0]}")
    for name, df in (("train", train), ("test", test)):
        if out_of_order(df).limit(1).count():
            raise NonTemporalSplit(f"{name} is not in time order")


def out_of_order(events: DataFrame) -> DataFrame:
    """Rows of a later place in the stream with an earlier time than some row before them.

    Neighbours suffice: the places are cut into stretches, whose ends are compared apart.
    """
    size = 1_000_000
    marked = events.withColumn("_stretch", F.floor(F.col("seq") / size))
    inside = marked.withColumn("_before", F.max("ts").over(Window.partitionBy("_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    ends = marked.groupBy("_stretch").agg(F.max("ts").alias("_max"))
    earlier = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_stretch", F.max("_max").over(earlier).alias("_past"))
    return inside.join(ends, "_stretch").filter(F.col("ts") < F.greatest("_before", "_past")).drop("_stretch", "_before", "_past")


def summary(events: DataFrame, by: list[str]) -> DataFrame:
    benign, n = F.col("scenario_id") == "benign", F.count(F.lit(1))
    scenarios = [c for s in SCENARIOS for c in (F.count_if(F.col("scenario_id") == s).alias(f"n_{s}"),)]
    distinct = [F.count_distinct(c).alias(f"distinct_{c}") for c in ("bin", "ip", "device_id", "card_ref", "merchant_id")]
    return events.groupBy(*by).agg(
        n.alias("n_rows"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), F.sum("label").alias("positives"),
        F.round(F.sum("label") / n, 6).alias("positive_rate"), *scenarios, F.count_if(benign).alias("benign_rows"),
        F.round(F.coalesce(F.try_divide(F.count_if(benign & (F.col("status") == "declined")), F.count_if(benign)), F.lit(0.0)), 6).alias("benign_decline_rate"), *distinct,
    )


def card_overlap(events: DataFrame) -> DataFrame:
    """How many cards of each kind of traffic the benign traffic has too."""
    kind = F.when(F.col("label") == 1, "attack").when(F.col("scenario_id").isin("flash_sale", "issuer_outage"), F.col("scenario_id"))
    benign = events.filter("scenario_id = 'benign'").select("card_ref").distinct()
    cards = events.select(kind.alias("kind"), "card_ref").filter("kind is not null").distinct()
    known = cards.join(benign, "card_ref", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("known_cards"))
    n = F.count(F.lit(1))
    per_kind = events.withColumn("kind", kind).filter("kind is not null").groupBy("kind").agg(
        n.alias("events"), F.count_distinct("card_ref").alias("distinct_cards"), F.round(n / F.count_distinct("card_ref"), 3).alias("attempts_per_card"),
        F.floor(F.percentile("amount_paise", F.lit(0.5))).cast("long").alias("median_amount_paise"),
    )
    out = per_kind.join(known, "kind", "left").na.fill(0, ["known_cards"])
    return out.withColumn("known_share", F.round(F.col("known_cards") / F.col("distinct_cards"), 6))


def episodes(events: DataFrame, span_ms: int) -> DataFrame:
    """(scenario_id, start_ms, end_ms) of attacks, one per scenario and stretch of time."""
    attacks = events.filter("label = 1").groupBy("scenario_id", F.floor(F.col("ts") / span_ms).alias("_k"))
    return attacks.agg(F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms")).drop("_k")


def schedule(episode_windows: DataFrame, boundary: int) -> DataFrame:
    """Episodes by scenario, on either side of the boundary."""
    side = F.when(F.col("start_ms") >= boundary, "test").otherwise("train")
    return episode_windows.withColumn("side", side).groupBy("scenario_id").pivot("side", ["train", "test"]).count().na.fill(0)
