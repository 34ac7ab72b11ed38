"""The score over Structured Streaming: keyed state per ip, then per bin, in one query.

Each stateful operator keeps one ``Entity`` per key (a ring of bounded size and a few sums) in the
state store and reads a micro-batch's rows of a key in stream order.  The bin operator takes what
the ip operator has added, so the two axes need no stream-stream join and no buffer.  A row older
than the last one of its key comes out marked late and does not touch the state.

The long-horizon variant has one more operator, which keeps the events of the long span of a bin in a list.  The unkeyed
baseline of the ``drop_ewma`` variant is two-stage: what the keyed operators give is cut into stretches of time in every
micro-batch, as in batch, and only the baseline's own few numbers go from one micro-batch to the next.  They are
written beside the results, by number of the micro-batch, so one that is run again starts from the same
numbers and writes the same rows over.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.model import TERMS, DetectorConfig, features_only
from tidemark.operators import score, stretches
from tidemark.operators.fold import Entity, Span, fields
from tidemark.operators.score import sum_in_order, term_columns
from tidemark.session import shared_dir, ship_package, written

#: Rows of a micro-batch of a stored stream, on average.
BATCH_ROWS = 2_000_000

STATE = T.StructType([T.StructField("state", T.BinaryType())])


class KeyedFold(StatefulProcessor):
    """One axis of the detector as a stateful operator."""

    def __init__(self, config: DetectorConfig, prefix: str, detail: bool, columns: list[str]):
        self.config, self.prefix, self.detail, self.columns = config, prefix, detail, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("entity", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], ignore_index=True)
        newest, entity = pickle.loads(self.held.get()[0]) if self.held.exists() else (None, Entity(self.config, self.detail))
        out, late = [], []
        blank = (0, 0, 0.0, 0.0, 0.0, False) + ((0, 0, 0, 0, False, 0.0, 0.0) if self.detail else ())
        for ts, seq, status, amount, card, merchant in zip(batch["ts"], batch["seq"], batch["status"], batch["amount_paise"], batch["card_ref"], batch["merchant_id"]):
            if newest is not None and (ts, seq) <= newest:
                late.append(True)
                out.append(blank)
                continue
            newest = (int(ts), int(seq))
            late.append(False)
            out.append(entity.step(int(ts), status == "declined", int(amount), card, merchant))
        self.held.update((pickle.dumps((newest, entity)),))
        added = pd.DataFrame(out, columns=[f.name for f in fields(self.prefix, self.detail)])
        batch["late"] = batch["late"] | pd.Series(late)
        yield pd.concat([batch[self.columns], added], axis=1)

    def close(self) -> None:
        pass


class KeyedSpan(StatefulProcessor):
    """Events and distinct cards of a key over a long span; the span's events are a list in the state store."""

    def __init__(self, span_ms: int, closed: bool, prefix: str, columns: list[str]):
        self.span_ms, self.closed, self.prefix, self.columns = span_ms, closed, prefix, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("span", SPAN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"], ignore_index=True)
        span = Span(self.span_ms, self.closed, [(row[0], row[1]) for row in self.held.get()])
        out = [(0, 0) if late else span.step(int(ts), card) for ts, card, late in zip(batch["ts"], batch["card_ref"], batch["late"])]
        self.held.put(list(span.held))
        yield pd.concat([batch[self.columns], pd.DataFrame(out, columns=[f"{self.prefix}_events", f"{self.prefix}_cards"])], axis=1)

    def close(self) -> None:
        pass


SPAN = T.StructType([T.StructField("ts", T.LongType()), T.StructField("card", T.StringType())])


def _stateful(stream: DataFrame, axis: str, prefix: str, detail: bool, config: DetectorConfig) -> DataFrame:
    schema = T.StructType([*stream.schema.fields, *fields(prefix, detail)])
    return stream.groupBy(axis).transformWithStateInPandas(KeyedFold(config, prefix, detail, stream.columns), outputStructType=schema, outputMode="Append", timeMode="None")


def _folded_stream(stream: DataFrame, config: DetectorConfig) -> DataFrame:
    """A stream of events with what the keyed operators know of them; late rows stay out."""
    ship_package(stream.sparkSession)
    rows = features_only(stream).withColumn("late", F.lit(False))
    if config.use_per_ip:
        rows = _stateful(rows, "ip", "ip", False, config)
    rows = _stateful(rows, "bin", "bin", True, config)
    if config.long_window_ms:
        schema = T.StructType([*rows.schema.fields, T.StructField("long_events", T.LongType()), T.StructField("long_cards", T.LongType())])
        rows = rows.groupBy("bin").transformWithStateInPandas(KeyedSpan(config.long_window_ms, False, "long", rows.columns), outputStructType=schema, outputMode="Append", timeMode="None")
    return rows.filter(~F.col("late"))


def _with_score(rows: DataFrame, config: DetectorConfig) -> DataFrame:
    return rows.withColumns(term_columns(config)).withColumn("score", sum_in_order([F.col(t) for t in TERMS]))


def scored_stream(stream: DataFrame, config: DetectorConfig) -> DataFrame:
    """A streaming DataFrame of events (with ``seq``) to one with terms and score; late rows stay out."""
    if not config.use_ewma:
        raise ValueError("the unkeyed baseline isn't keyed state: see start_scoring")
    return _with_score(_folded_stream(stream, config), config)


def _unkeyed_batch(path: str, config: DetectorConfig, session: SparkSession | None = None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch does with the unkeyed baseline; its results and the state after it have its number.

    The written batch is read in ``session``, the one that the stream was started from: a micro-batch's own has no adaptive execution, so
    that every small step of the baseline would have all the partitions of the keyed state.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = session or batch.sparkSession
        before = spark.read.schema(_STATES).parquet(f"{path}/baseline/n={number - 1}").first() if number else None
        rows = written(batch, "stream-batch", spark)
        if rows.isEmpty():
            spark.createDataFrame([before] if before else [], _STATES).write.mode("overwrite").parquet(f"{path}/baseline/n={number}")
            return
        found, after = stretches.with_unkeyed_baseline(rows, "bin_events", config, score.STRETCH_ROWS, before=before[stretches.RESUME].asDict(recursive=True) if before else None)
        _with_score(found, config).write.mode("overwrite").parquet(f"{path}/rows/n={number}")
        after.write.mode("overwrite").parquet(f"{path}/baseline/n={number}")

    return run


_STATES = T.StructType([T.StructField(stretches.RESUME, stretches.STATE)])


def start_scoring(stream: DataFrame, config: DetectorConfig, base: str) -> StreamingQuery:
    """Start the query that scores ``stream`` into ``base``; it ends once it has read what there is."""
    checkpoint = f"{base}/checkpoint"
    if config.use_ewma:
        writer = scored_stream(stream, config).writeStream.format("parquet").option("path", f"{base}/out/rows")
    else:
        writer = _folded_stream(stream, config).writeStream.foreachBatch(_unkeyed_batch(f"{base}/out", config, stream.sparkSession))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, rows: DataFrame, start: Callable[[DataFrame, str], StreamingQuery], batches: int, queries: list[StreamingQuery] | None = None) -> DataFrame:
    """Feed stored ``rows`` (with ts) to a query in at least ``batches`` stretches of time and give back what its sink holds.

    There are as many equal stretches as it takes for ``BATCH_ROWS`` each on average, since a task holds a key's rows of a micro-batch.
    A stretch is fed whole, in as many files as it has partitions, and the query starts again from its checkpoint.  The queries
    that have run are added to ``queries``.
    """
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    first, last, n = rows.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    batches = max(batches, -(-n // BATCH_ROWS))
    step = ((last or 0) - (first or 0)) // batches + 1
    number = F.least(F.greatest(F.floor((F.col("ts") - F.lit(first or 0)) / step), F.lit(0)), F.lit(batches - 1))
    # dealt to stretches once, so that rows are read twice however many stretches there are
    rows.withColumn("_batch", number.cast("int")).write.partitionBy("_batch").parquet(f"{base}/dealt")
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{base}/dealt")
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for k in range(batches):
            dealt.filter(F.col("_batch") == k).drop("_batch").write.mode("append").parquet(f"{base}/in")
            query = start(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), base)
            query.awaitTermination()
            if queries is not None:
                queries.append(query)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.parquet(f"{base}/out/rows")


def run_to_end(spark: SparkSession, events: DataFrame, config: DetectorConfig, batches: int = 2, queries: list[StreamingQuery] | None = None) -> DataFrame:
    """Score a stored stream as a stream; its rows are written once, so that every stretch is cut from the same ones."""
    rows = written(features_only(events), "stream-rows")
    return replay(spark, rows, lambda stream, base: start_scoring(stream, config, base), batches, queries)


# -- extensions that the stream gives for free --------------------------------------------------------
def windowed_report(stream: DataFrame, length: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and declines per merchant and event-time window; rows later than the watermark drop."""
    timed = stream.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", lateness)
    window = F.window("time", length, slide) if slide else F.window("time", length)
    return timed.groupBy(window, "merchant_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "declined").alias("declines"), F.sum("amount_paise").alias("amount_paise"), F.approx_count_distinct("card_ref").alias("cards"))


def deduplicated(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The first of the rows that share a transaction id within the watermark."""
    return stream.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", lateness).dropDuplicatesWithinWatermark(["txn_id"]).drop("time")


def alert_sessions(flags: DataFrame, cooldown_ms: int, lateness: str = "1 hour") -> DataFrame:
    """Alerts as session windows per (merchant, bin) over a stream of flags."""
    timed = flags.withColumn("time", F.timestamp_millis("ts")).withWatermark("time", lateness)
    session = F.session_window("time", f"{cooldown_ms} milliseconds")
    return timed.groupBy(session, "merchant_id", "bin").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"), F.max("score").alias("max_score"))
