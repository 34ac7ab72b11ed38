"""Routing of flags: deduplication, exposure, kill switch, decision, audit trail.

Routing state is columns: everything but the kill switch is a window or an expression.  The hold
of the kill switch depends on its own last trip, so flags are read once in the order of their
key, with one number of state; the flags of a busy key in stretches of time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import grounding
from tidemark.model import TriageConfig
from tidemark.operators import spans, stretches
from tidemark.operators.metrics import with_alert_interval
from tidemark.session import ship_package, written

KEYS = ["merchant_id", "bin"]
NO_EXPLAINER = "no explainer wired"


def exposure(config: TriageConfig) -> Column:
    priced = config.chargeback_rate * (config.chargeback_fee_paise + config.chargeback_loss_fraction * F.col("amount_paise"))
    return F.when(F.col("status") == "approved", priced).otherwise(float(config.auth_fee_paise))


def retry_ratio(flags: DataFrame) -> DataFrame:
    """``flags`` with events per card of the trailing hour, to four places."""
    ship_package(flags.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def ratio(events: pd.Series, cards: pd.Series) -> pd.Series:
        return pd.Series([round(e / c, 4) if c else 0.0 for e, c in zip(events.tolist(), cards.tolist())], dtype="float64")

    return flags.withColumn("retry_ratio", ratio("trail_events", "trail_cards"))


def _trips_on(config: TriageConfig) -> Column:
    """Flags at which the kill switch trips unless it holds already."""
    return (F.col("trail_events") >= config.min_events) & (F.col("retry_ratio") >= config.retry_ratio)


def _switched(rows: DataFrame, group: list[str], columns: list[str], config: TriageConfig) -> DataFrame:
    """``columns`` of ``rows`` (with _trips, and with what is due before each group) with tripped and tripped_now."""
    names = rows.columns
    of = [names.index(c) for c in group]
    at = [names.index(c) for c in ("due", "ts", "_trips")]
    kept_at = [names.index(c) for c in columns]
    out_names = [*columns, "tripped", "tripped_now"]
    cooldown = config.kill_cooldown_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, stretches.NEVER
        for batch in batches:
            kept, out = [], []
            keys = zip(*(batch.column(c).to_pylist() for c in of))
            for i, (here, due, ts, trips) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in at))):
                if here != key:
                    key, until = here, stretches.NEVER
                if due is not None:
                    until = due
                    continue
                held = ts < until
                now = not held and trips
                if now:
                    until = ts + cooldown
                kept.append(i)
                out.append((held or now, now))
            some = batch.take(pa.array(kept, pa.int64()))
            values = zip(*out) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept_at), *(pa.array(list(v), pa.bool_()) for v in values)], names=out_names)

    dealt = rows.repartition(*group).sortWithinPartitions(*group, F.col("due").isNull(), "ts", "seq")
    return dealt.mapInArrow(run, T.StructType([*(rows.schema[c] for c in columns), T.StructField("tripped", T.BooleanType()), T.StructField("tripped_now", T.BooleanType())]))


def kill_switch(flags: DataFrame, config: TriageConfig, hot: int = stretches.HOT) -> DataFrame:
    """``flags`` (with trail_events, trail_cards) plus retry_ratio, tripped and tripped_now.

    The switch is a gate over the flags at which it would trip, so a key of over ``hot`` flags is cut into
    stretches of time that are told until when it holds (``stretches.entry_dues``).
    """
    never = F.lit(None).cast("long").alias("due")
    marked = retry_ratio(flags)
    columns = marked.columns
    marked = marked.withColumn("_trips", _trips_on(config))
    if not stretches.large(flags, hot):
        return _switched(marked.select("*", never), KEYS, columns, config)
    marked = written(marked.withColumn(stretches.KEY, stretches.key_of(KEYS)), "flags")
    busy = written(stretches.busy_keys(marked, stretches.KEY, hot), "busy-keys")
    cold = marked.join(busy.select(stretches.KEY), stretches.KEY, "left_anti")
    few = _switched(cold.select("*", never), KEYS, columns, config)
    if busy.isEmpty():
        return few
    bare = marked.join(busy.select(stretches.KEY), stretches.KEY, "left_semi")
    cut = stretches.cuts(bare, busy, hot, 1)
    placed = stretches.placed(bare, cut).drop(stretches.GHOST)
    steps = stretches.step_tables(placed.filter("_trips"), config.kill_cooldown_ms)
    dues = stretches.entry_dues(stretches.all_steps(steps, cut))
    return few.unionByName(_switched(placed.select("*", never).unionByName(dues, allowMissingColumns=True), [stretches.KEY, stretches.STRETCH], columns, config))


def route(rows: DataFrame, threshold: float, config: TriageConfig, interrupt: bool = False, hot: int = stretches.HOT) -> DataFrame:
    """Each flag of ``rows`` (all scored events of the window, flagged or not) with its routing; keys of over ``hot`` events are cut."""
    trailing = spans.trailing(rows, KEYS, config.trailing_ms, True, "trail", hot)
    flags = trailing.filter(F.col("score") > threshold)
    # with no flag of the key in the cooldown before it
    alone = with_alert_interval(flags, config.dedup_cooldown_ms, "_before").withColumn("new_alert", F.col("_before") == F.lit(float("-inf"))).drop("_before")
    return decided(kill_switch(alone.withColumn("exposure_paise", exposure(config)), config, hot), threshold, config, interrupt)


def decided(switched: DataFrame, threshold: float, config: TriageConfig, interrupt: bool = False) -> DataFrame:
    """Flags whose routing state is known, with mode, decision and the path that they walk."""
    inline = F.lit(config.mode == "inline") & ~F.col("tripped")
    moded = switched.withColumn("mode", F.when(inline, "inline").otherwise("alert_only"))
    reviewed = F.when(F.col("new_alert"), "alert").otherwise("alert_dedup")
    out = moded.withColumn("decision", F.when(F.col("mode") == "inline", "decline").otherwise(reviewed))
    return out.withColumns({"threshold": F.lit(float(threshold)), "halted": (F.col("mode") != "inline") & F.lit(interrupt), "path": path(interrupt)})


def path(interrupt: bool = False, grounded: Column | None = None) -> Column:
    """The nodes a flag walks, from the routing columns."""
    from tidemark.operators.graph import walk

    text = lambda nodes: F.array(*[F.lit(n) for n in nodes])
    ways = lambda ok: F.when(F.col("mode") == "inline", text(walk("decline", halted=False, grounded=ok))).otherwise(text(walk("alert", halted=interrupt, grounded=ok)))
    return ways(False) if grounded is None else F.when(grounded, ways(True)).otherwise(ways(False))


def explained(routed: DataFrame, notes: DataFrame, interrupt: bool = False) -> DataFrame:
    """``routed`` with an explainer's notes (txn_id, note) judged against each flag's own prompt.

    A grounded note ends the walk; one that isn't, or none, goes on to the template, and the reason
    is kept.  Routing is settled before and is not touched.
    """
    told = routed.join(notes.select("txn_id", "note"), "txn_id", "left").withColumn("prompt", grounding.evidence_prompt())
    judged = told.withColumn("_why", grounding.reasons(F.col("note"), F.col("prompt")))
    ok = F.col("note").isNotNull() & (F.size("_why") == 0)
    why = F.when(F.col("note").isNull(), NO_EXPLAINER).when(ok, "").otherwise(F.concat_ws("; ", "_why"))
    return judged.withColumns({"note_grounded": ok, "reject_reason": why}).withColumn("path", path(interrupt, F.col("note_grounded"))).drop("_why")


def trips(routed: DataFrame) -> DataFrame:
    return routed.filter("tripped_now").select("txn_id", "ts", "merchant_id", "bin", F.col("trail_events").alias("window_events"), F.col("trail_cards").alias("window_cards"), "retry_ratio")


def audit(routed: DataFrame) -> DataFrame:
    """One row per flag and node, with what was known once the node had run."""
    if "note_grounded" not in routed.columns:
        routed = routed.withColumns({"note_grounded": F.lit(False), "reject_reason": F.lit(NO_EXPLAINER)})
    steps = routed.select("*", F.posexplode("path").alias("step", "node"))
    node, step = F.col("node"), F.col("step")
    since = {"exposure": 1, "kill_switch": 2, "mode": 3}
    known = {n: step >= k for n, k in since.items()}
    late = step >= 4
    decided = F.when(F.col("mode") == "inline", "decline").otherwise("alert")
    return steps.select(
        "txn_id", "ts", "step", "node", "merchant_id", "bin",
        F.when(late, F.col("decision")).when(known["mode"], decided).otherwise("").alias("decision"),
        F.when(known["mode"], F.col("mode")).otherwise("").alias("mode"),
        "new_alert",
        F.when(known["kill_switch"], F.col("tripped")).otherwise(False).alias("tripped"),
        F.when(known["kill_switch"], F.col("tripped_now")).otherwise(False).alias("tripped_now"),
        F.when(known["kill_switch"], F.col("retry_ratio")).otherwise(0.0).alias("retry_ratio"),
        F.when(known["kill_switch"], F.col("trail_events")).otherwise(0).alias("window_events"),
        F.when(known["exposure"], F.round("exposure_paise", 2)).otherwise(0.0).alias("exposure_paise"),
        (node.isin("ground", "template") & F.col("note_grounded")).alias("note_grounded"),
        F.when(node.isin("explain", "ground", "template"), F.col("reject_reason")).otherwise("").alias("reject_reason"),
        F.round("score", 6).alias("score"),
        F.round("threshold", 6).alias("threshold"),
    )


def with_decisions(rows: DataFrame, routed: DataFrame) -> DataFrame:
    """All events with the decision on them (empty: not flagged)."""
    return rows.join(routed.select("seq", "decision", "new_alert"), "seq", "left").na.fill("", ["decision"]).na.fill(False, ["new_alert"])


def masked_score(kept: Column) -> Column:
    """The score of rows that count, and below everything for the others."""
    return F.when(kept, F.col("score")).otherwise(F.lit(float("-inf")))


def comparison(decided: DataFrame, threshold: float) -> DataFrame:
    """By scenario: events, flagged, declined, alerted."""
    flagged = F.count_if(F.col("score") > threshold)
    return decided.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("events"), flagged.alias("flagged"), F.count_if(F.col("decision") == "decline").alias("declined"), F.count_if(F.col("decision").startswith("alert")).alias("alerted"))


def report(decided: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Raw against triaged: what declines alone cost and catch."""
    flagged, declined = F.col("score") > threshold, F.col("decision") == "decline"
    clean, approved = F.col("label") == 0, F.col("status") == "approved"
    blocked = lambda on: F.coalesce(F.sum(F.when(on & clean & approved, F.col("amount_paise"))), F.lit(0)) * margin / 100.0
    rate = lambda on: F.coalesce(F.try_divide(F.count_if(on & clean), F.count_if(clean)), F.lit(0.0))
    return decided.agg(
        F.count_if(flagged).alias("flagged"), F.count_if(declined).alias("declined"), F.count_if("new_alert").alias("alerts"),
        F.count_if(flagged & ~clean).alias("tp_raw"), F.count_if(declined & ~clean).alias("tp_declined"), F.count_if(flagged & clean).alias("fp_raw"), F.count_if(declined & clean).alias("fp_declined"),
        rate(flagged).alias("legit_decline_rate_raw"), rate(declined).alias("legit_decline_rate"), blocked(flagged).alias("blocked_good_rupees_raw"), blocked(declined).alias("blocked_good_rupees"),
    )
