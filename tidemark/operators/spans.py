"""Events and distinct cards of a key over a long span, also of keys too busy for one task.

*Visits.*  A card's events that are no more than the span apart are one visit.  A card is in the span that ends at an event
exactly if one of its visits has begun by then and wasn't over before the span; two visits of a card are never in it together.
So distinct cards are a dominance count in one dimension: visits begun so far less visits that ended before the span.  Whether an event opens or
closes a visit is told by the card's events next to it, and nothing else of the span is looked at.

*Running totals.*  Every event arrives at its time and departs once the span has gone by; with what it
opens and closes, both counts are running sums over arrivals and departures in order of time.  A busy key's are cut into stretches of time
(``stretches.cuts``), which sum on their own and start from the totals of those before: no task reads a whole key, and none holds a span.

Keys of few events go through ``fold.trailing_fold``, one sorted pass without a second exchange; the numbers are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import stretches
from tidemark.operators.fold import trailing_fold
from tidemark.operators.stretches import KEY, STRETCH
from tidemark.session import written


def visits(rows: DataFrame, reach_ms: int) -> DataFrame:
    """``rows`` (with _key, _stretch, card_ref, ts, seq) with ``opens`` and ``closes``: whether a visit of the card begins and ends there.

    Neighbours in a stretch are found by a window; of a card in a stretch only the first and the last time go on to the other stretches.
    """
    own = [KEY, "card_ref", STRETCH]
    ends = rows.groupBy(*own).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    along = Window.partitionBy(KEY, "card_ref").orderBy(STRETCH)
    ends = ends.select(*own, F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    order = Window.partitionBy(*own).orderBy("ts", "seq")
    told = rows.join(ends, own)
    before, after = F.coalesce(F.lag("ts").over(order), F.col("_before")), F.coalesce(F.lead("ts").over(order), F.col("_after"))
    opens = F.coalesce(F.col("ts") - before > reach_ms, F.lit(True))
    closes = F.coalesce(after - F.col("ts") > reach_ms, F.lit(True))
    return told.select(*rows.columns, opens.alias("opens"), closes.alias("closes"))


def split_trailing(events: DataFrame, keys: list[str], span_ms: int, closed: bool, prefix: str, busy: DataFrame, size: int) -> DataFrame:
    """``trailing_fold`` of the keys in ``busy`` (_key, _n, _from, _to), cut into stretches of about ``size`` arrivals and departures."""
    reach = span_ms if closed else span_ms - 1
    columns = events.columns
    keyed = events.withColumn(KEY, stretches.key_of(keys))
    bare = keyed.select(KEY, "ts").join(busy.select(KEY), KEY, "left_semi")
    times = bare.select(KEY, F.explode(F.array(F.col("ts"), F.col("ts") + reach)).alias("ts"))
    cut = stretches.cuts(times, busy.select(KEY, (F.col("_n") * 2).alias("_n"), "_from", (F.col("_to") + reach).alias("_to")), size, 1)
    told = visits(stretches.placed(keyed, cut).drop(stretches.GHOST), reach)
    # a departure has nothing of its event but when it is and what it closes
    both = told.withColumn("_leaves", F.explode(F.array(F.lit(False), F.lit(True))))
    stays = ~F.col("_leaves")
    moved = both.select(
        KEY, "_leaves", F.col("seq").alias("_seq"), *[F.when(stays, F.col(c)).alias(c) for c in columns if c != "ts"],
        (F.col("ts") + F.when(stays, 0).otherwise(reach)).alias("ts"),
        F.when(stays, 1).otherwise(-1).cast("long").alias("_e"),
        F.when(stays, F.col("opens").cast("long")).otherwise(-F.col("closes").cast("long")).alias("_c"),
    )
    moved = written(stretches.placed(moved, cut).drop(stretches.GHOST), "span-moves")
    # a row per key and stretch
    earlier = Window.partitionBy(KEY).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    totals = moved.groupBy(KEY, STRETCH).agg(F.sum("_e").alias("_e"), F.sum("_c").alias("_c"))
    offsets = totals.select(KEY, STRETCH, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_from{c}") for c in ("_e", "_c")])
    within = Window.partitionBy(KEY, STRETCH).orderBy("ts", "_leaves", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = moved.join(offsets, [KEY, STRETCH]).withColumns({f"_sum{c}": F.sum(c).over(within) + F.col(f"_from{c}") for c in ("_e", "_c")})
    return summed.filter(~F.col("_leaves")).select(*columns, F.col("_sum_e").alias(f"{prefix}_events"), F.col("_sum_c").alias(f"{prefix}_cards"))


def trailing(events: DataFrame, keys: list[str], span_ms: int, closed: bool, prefix: str, hot: int = stretches.HOT) -> DataFrame:
    """``events`` with the events and distinct cards of ``keys`` over a long span; keys of over ``hot`` events are cut into stretches.

    ``closed``: [t - span, t]; else (t - span, t].
    """
    if not stretches.large(events, hot):
        return trailing_fold(events, keys, span_ms, closed, prefix)
    busy = written(stretches.busy_keys(events.withColumn(KEY, stretches.key_of(keys)), KEY, hot), "busy-keys")
    if busy.isEmpty():
        return trailing_fold(events, keys, span_ms, closed, prefix)
    cold = events.withColumn(KEY, stretches.key_of(keys)).join(busy.select(KEY), KEY, "left_anti").select(*events.columns)
    return trailing_fold(cold, keys, span_ms, closed, prefix).unionByName(split_trailing(events, keys, span_ms, closed, prefix, busy, hot))
