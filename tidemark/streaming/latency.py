"""How long events wait in a stream, as measured: each micro-batch's time is that of all its events.

A query keeps what it reports of its last micro-batches; ``measured`` makes a table of it.  Percentiles of one query are exact
(``percentiles``).  Those over many queries, days or clusters come from sketches that merge (``sketches``, ``merged``): of a sketch of size ``K`` the
rank of an answer is off by at most ``RANK_ERROR`` of all values, with a confidence of 99 %.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: Size of a sketch, and the part of all values that the rank of an answer may be off by at this size.
K, RANK_ERROR = 800, 0.0045
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
_SCHEMA = "run string, batch long, events long, total_ms double, fetch_ms double, run_ms double, commit_ms double"


def measured(spark: SparkSession, queries: list[StreamingQuery]) -> DataFrame:
    """(run, batch, events, total_ms, fetch_ms, run_ms, commit_ms) of the micro-batches with events that queries tell of."""
    rows = []
    for query in queries:
        for p in query.recentProgress:
            took = p["durationMs"]
            if p["numInputRows"]:
                rows.append((str(p["runId"]), int(p["batchId"]), int(p["numInputRows"]), *(float(took.get(k, 0)) for k in ("triggerExecution", "latestOffset", "addBatch", "commitOffsets"))))
    return spark.createDataFrame(rows, _SCHEMA)


def percentiles(batches: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """One row: events, events a second, and the time at index int(events * share) of all events' times in order."""
    shares = shares or SHARES
    # a row per micro-batch
    ordered = Window.orderBy("total_ms", "run", "batch")
    ranked = batches.withColumn("_up", F.sum("events").over(ordered)).withColumn("_n", F.sum("events").over(Window.partitionBy()))
    place = lambda q: F.least(F.floor(F.col("_n") * q).cast("long") + 1, F.col("_n"))
    rate = F.try_divide(F.sum("events") * 1000.0, F.sum("total_ms"))
    return ranked.agg(F.sum("events").alias("events"), rate.alias("events_per_sec"), *[F.min(F.when(F.col("_up") >= place(q), F.col("total_ms"))).alias(f"{n}_ms") for n, q in shares.items()])


def sketches(rows: DataFrame, group: list[str], value: str, k: int = K) -> DataFrame:
    """(group, sketch) of a number: of bounded size, however many rows."""
    return rows.groupBy(*group).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(sketched: DataFrame, group: list[str], shares: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """(group, n, a column a share) from sketches of parts."""
    whole = sketched.groupBy(*group).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"))
    found = [F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(n) for n, q in (shares or SHARES).items()]
    return whole.select(*group, F.kll_sketch_get_n_double("_s").alias("n"), *found)
