"""Routing of flags as a stream: trailing hour, deduplication and kill switch as keyed state, and reviews that come later.

*Router.*  Every scored event of a (merchant, bin) enters the key's trailing hour, a list in the state store; a flag meets what the
key has been through: when its last flag was, and until when its kill switch holds.  An event-time timer stands at the time
from which on nothing of a key matters any more (its trailing hour is empty, the hold and the cooldown are over); once the watermark
has passed it, the key's state is dropped, and a key that comes back later finds what it would have found.  Events behind the watermark don't come in.

*Reviews.*  A flag that waits for a reviewer is kept until a decision on it arrives or the time for it is up, whichever comes
first in event time; then the rest of its walk is told.  Nothing of it is told twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.model import TriageConfig
from tidemark.operators import triage
from tidemark.operators.fold import Span
from tidemark.session import ship_package, written
from tidemark.streaming.scoring import SPAN, replay

_ROUTE = T.StructType([T.StructField(n, T.LongType()) for n in ("ts", "seq", "flagged", "until")])
_ADDED = [
    T.StructField("trail_events", T.LongType()), T.StructField("trail_cards", T.LongType()), T.StructField("new_alert", T.BooleanType()),
    T.StructField("retry_ratio", T.DoubleType()), T.StructField("tripped", T.BooleanType()), T.StructField("tripped_now", T.BooleanType()),
]


def _set_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer a key: the others are taken off."""
    for old in list(handle.listTimers()):
        if old != at_ms:
            handle.deleteTimer(old)
    handle.registerTimer(at_ms)


class Router(StatefulProcessor):
    """The routing state of one (merchant, bin)."""

    def __init__(self, threshold: float, config: TriageConfig, columns: list[str]):
        self.threshold, self.config, self.columns = threshold, config, columns
        self.horizon = max(config.trailing_ms, config.dedup_cooldown_ms, config.kill_cooldown_ms) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trail = handle.getListState("trail", SPAN)
        self.route = handle.getValueState("route", _ROUTE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], ignore_index=True)
        config = self.config
        span = Span(config.trailing_ms, True, [(row[0], row[1]) for row in self.trail.get()])
        newest_ts, newest_seq, flagged, until = self.route.get() if self.route.exists() else (None, None, None, -1)
        kept, out = [], []
        for i, (ts, seq, card, score) in enumerate(zip(batch["ts"].tolist(), batch["seq"].tolist(), batch["card_ref"], batch["score"].tolist())):
            if newest_ts is not None and (ts, seq) <= (newest_ts, newest_seq):
                continue  # late, or sent again
            newest_ts, newest_seq = ts, seq
            events, cards = span.step(ts, card)
            if not score > self.threshold:
                continue
            ratio = round(events / cards, 4)
            held = ts < until
            now = not held and events >= config.min_events and ratio >= config.retry_ratio
            if now:
                until = ts + config.kill_cooldown_ms
            kept.append(i)
            out.append((events, cards, flagged is None or ts - flagged > config.dedup_cooldown_ms, ratio, held or now, now))
            flagged = ts
        self.trail.put(list(span.held))
        self.route.update((newest_ts, newest_seq, flagged, until))
        _set_timer(self.handle, newest_ts + self.horizon)
        added = pd.DataFrame(out, columns=[f.name for f in _ADDED])
        yield pd.concat([batch.loc[kept, self.columns].reset_index(drop=True), added], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.trail.clear()
        self.route.clear()
        return iter([])

    def close(self) -> None:
        pass


def timed(rows: DataFrame, lateness: str) -> DataFrame:
    return rows.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", lateness)


def routed_stream(scored: DataFrame, threshold: float, config: TriageConfig, interrupt: bool = False, lateness: str = "1 hour") -> DataFrame:
    """A stream of scored events (all, flagged or not) to one of flags with their routing, as ``triage.route`` gives it in batch."""
    ship_package(scored.sparkSession)
    columns = scored.columns
    schema = T.StructType([*scored.schema.fields, *_ADDED])
    flags = timed(scored, lateness).groupBy(*triage.KEYS).transformWithStateInPandas(Router(threshold, config, columns), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return triage.decided(flags.withColumn("exposure_paise", triage.exposure(config)), threshold, config, interrupt)


# -- reviews ------------------------------------------------------------------------------------------------
_PENDING = T.StructType([T.StructField("flag_ts", T.LongType())])
_RESUMED = T.StructType([T.StructField("txn_id", T.StringType()), T.StructField("flag_ts", T.LongType()), T.StructField("resumed_ts", T.LongType()), T.StructField("verdict", T.StringType())])
EXPIRED = "expired"


class Reviewed(StatefulProcessor):
    """One flag that waits: for a verdict, or until its time is up."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", _PENDING)
        self.done = handle.getValueState("done", _PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        waits = batch[batch["verdict"].isna()]
        if len(waits) and not self.done.exists() and not self.pending.exists():
            at = int(waits["ts"].min())
            self.pending.update((at,))
            _set_timer(self.handle, at + self.patience_ms)
        if not self.pending.exists():
            return  # no such flag yet, or it has gone on
        (at,) = self.pending.get()
        # a verdict from before the flag isn't one on it; the first counts, of verdicts at one time the least
        verdicts = batch[batch["verdict"].notna() & (batch["ts"] >= at) & (batch["ts"] < at + self.patience_ms)].sort_values(["ts", "verdict"])
        if len(verdicts):
            yield self._resumed(key, at, int(verdicts["ts"].iloc[0]), verdicts["verdict"].iloc[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            (at,) = self.pending.get()
            yield self._resumed(key, at, at + self.patience_ms, EXPIRED)
        self.done.clear()

    def _resumed(self, key, at: int, ts: int, verdict: str) -> pd.DataFrame:
        self.pending.clear()
        self.done.update((at,))
        return pd.DataFrame([(key[0], at, ts, verdict)], columns=_RESUMED.names)

    def close(self) -> None:
        pass


def resumed_stream(messages: DataFrame, patience_ms: int, lateness: str = "1 hour") -> DataFrame:
    """A stream of (txn_id, ts, verdict) to one of (txn_id, flag_ts, resumed_ts, verdict): where halted walks go on.

    A message without a verdict is a halted flag, one with is a reviewer's.  A flag no one has decided on within ``patience_ms`` goes on as ``EXPIRED``.
    Both kinds come in one stream (a union of two is one), so that their order in event time is the watermark's.
    """
    ship_package(messages.sparkSession)
    return timed(messages.select("txn_id", "ts", "verdict"), lateness).groupBy("txn_id").transformWithStateInPandas(Reviewed(patience_ms), outputStructType=_RESUMED, outputMode="Append", timeMode="EventTime")


def resumed(flags: DataFrame, verdicts: DataFrame, patience_ms: int) -> DataFrame:
    """The same in batch: of halted ``flags`` (txn_id, ts) and ``verdicts`` (txn_id, ts, verdict), each as of its flag's time."""
    halted = flags.groupBy("txn_id").agg(F.min("ts").alias("flag_ts"))
    told = verdicts.select("txn_id", F.col("ts").alias("_ts"), "verdict")
    fits = (F.col("_ts") >= F.col("flag_ts")) & (F.col("_ts") < F.col("flag_ts") + patience_ms)
    first = halted.join(told, "txn_id", "left").groupBy("txn_id", "flag_ts").agg(F.min(F.when(fits, F.struct("_ts", "verdict"))).alias("_v"))
    return first.select("txn_id", "flag_ts", F.coalesce(F.col("_v._ts"), F.col("flag_ts") + patience_ms).alias("resumed_ts"), F.coalesce(F.col("_v.verdict"), F.lit(EXPIRED)).alias("verdict"))


# -- stored streams -------------------------------------------------------------------------------------------
def _sink(stream: DataFrame, base: str):
    return stream.writeStream.format("parquet").option("path", f"{base}/out/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()


def route_to_end(spark: SparkSession, scored: DataFrame, threshold: float, config: TriageConfig, batches: int = 2, interrupt: bool = False) -> DataFrame:
    """Route stored scored events as a stream."""
    return replay(spark, written(scored, "route-rows"), lambda stream, base: _sink(routed_stream(stream, threshold, config, interrupt), base), batches)


def resume_to_end(spark: SparkSession, flags: DataFrame, verdicts: DataFrame, patience_ms: int, batches: int = 2) -> DataFrame:
    """Resume stored halted flags by stored verdicts as a stream; a last message, long after all others, lets what is left expire."""
    both = flags.select("txn_id", "ts", F.lit(None).cast("string").alias("verdict")).unionByName(verdicts.select("txn_id", "ts", "verdict"))
    rows = written(both, "review-rows")
    last = rows.agg(F.max("ts")).first()[0] or 0
    closing = spark.range(1).select(F.lit("").alias("txn_id"), F.lit(last + patience_ms + 10 * 3_600_000).alias("ts"), F.lit("none").alias("verdict"))
    return replay(spark, written(rows.unionByName(closing), "review-rows"), lambda stream, base: _sink(resumed_stream(stream, patience_ms), base), batches)
