"""The keyed fold for hot keys: a key's stream is cut into stretches of time that go to tasks of their own.

*Stretches* hold about as many events each, not as much time: events are counted in cells of time, and cells next
to each other make a stretch.  One isn't shorter than a window, so a window reaches into the one before at most.

*Gates* are composed.  A sample is taken at the first time that has come due, and then the gate is due again an interval
later.  What a stretch does to the due time it is entered with is a step function with few steps: only times in its
first interval can start a chain of samples, and chains meet.  Each stretch writes down its function, functions of
stretches next to each other are composed in a tree, and the due time of every stretch comes down the tree.

*Baselines* depend on samples alone, of which there is one per gate interval at most.  They are read once in order, and every stretch is told
the state that it starts from.

*Rows* then are folded as those of any other key: a stretch starts from its state and takes along the events of
one window before it.  All numbers are those of ``fold.entity_fold``, operation by operation; rows are dealt twice, once narrow, and never joined with
themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import DetectorConfig
from tidemark.operators.fold import GHOST, RESUME, STATE, STATE_ARROW, Entity, as_text, codes, entity_fold, resumed_fold
from tidemark.session import ship_package, written

#: Events of a key from which on it is cut, and events that a stretch aims for.
HOT = 5_000_000
#: Bytes that a row takes at least in a compressed file.
LEAST_BYTES = 4
#: Cells of time in a stretch, about; functions that are composed in one task.
CELLS, FAN = 16, 64
#: Before all times: what a gate that never was is due at.
NEVER = -(2**63)
#: The number of what comes behind all stretches.
END = 2**62
KEY, STRETCH = "_key", "_stretch"


# -- stretches ----------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Cuts:
    """Where keys are cut: (_key, _from, _width) and (_key, _cell, _stretch, _next), ``_next`` being when the next stretch starts."""

    keys: DataFrame
    cells: DataFrame


def large(rows: DataFrame, hot: int) -> bool:
    """Whether ``rows`` may hold a key of over ``hot`` rows.

    They are counted only if Spark's own estimate of their size leaves room for so many; where that isn't known, it does.
    """
    estimate = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return estimate > hot * LEAST_BYTES and rows.count() > hot


def key_of(columns: list[str]):
    """One string for the values of several columns."""
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def busy_keys(events: DataFrame, axis: str, hot: int) -> DataFrame:
    """(_key, _n, _from, _to) of keys of over ``hot`` events."""
    counted = events.groupBy(F.col(axis).alias(KEY)).agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    return counted.filter(F.col("_n") > hot)


def cuts(times: DataFrame, keys: DataFrame, size: int, least_ms: int) -> Cuts:
    """Stretches of about ``size`` of the ``times`` (_key, ts), none shorter than ``least_ms``."""
    share = (F.col("_to") - F.col("_from") + 1) * F.lit(float(size)) / (F.col("_n") * F.lit(float(CELLS)))
    width = F.greatest(F.ceil(share).cast("long"), F.lit(max(1, least_ms)).cast("long"))
    keys = written(keys.select(KEY, "_from", width.alias("_width")), "cut-keys")
    cells = times.select(KEY, "ts").join(keys, KEY).groupBy(KEY, _cell().alias("_cell")).agg(F.count(F.lit(1)).alias("_c"), F.first("_from").alias("_from"), F.first("_width").alias("_width"))
    own = Window.partitionBy(KEY).orderBy("_cell")
    before = F.coalesce(F.sum("_c").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = cells.withColumn("_number", F.floor(before / F.lit(size)).cast("long"))
    opens = numbered.withColumn("_opens", F.coalesce(F.lag("_number").over(own) < F.col("_number"), F.lit(False)))
    placed = opens.withColumn(STRETCH, F.sum(F.col("_opens").cast("long")).over(own))
    start = F.when(F.col("_opens"), F.col("_from") + F.col("_cell") * F.col("_width"))
    # backwards: a frame up to the end of the key would be read anew for every cell
    back = Window.partitionBy(KEY).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.min(start).over(back)
    return Cuts(keys, written(placed.select(KEY, "_cell", STRETCH, following.alias("_next")), "cut-cells"))


def _cell():
    return F.floor((F.col("ts") - F.col("_from")) / F.col("_width")).cast("long")


def placed(rows: DataFrame, cut: Cuts, reach_ms: int = 0) -> DataFrame:
    """``rows`` (with _key, ts) with their stretch; those within ``reach_ms`` of the next one's start are in it too, as ghosts."""
    columns = rows.columns
    found = rows.join(cut.keys, KEY).withColumn("_cell", _cell()).join(cut.cells, [KEY, "_cell"])
    if reach_ms <= 0:
        return found.select(*columns, STRETCH, F.lit(False).alias(GHOST))
    here = F.struct(F.col(STRETCH).alias("s"), F.lit(False).alias("g"))
    tail = F.coalesce(F.col("ts") > F.col("_next") - reach_ms, F.lit(False))
    at = F.when(tail, F.array(here, F.struct((F.col(STRETCH) + 1).alias("s"), F.lit(True).alias("g")))).otherwise(F.array(here))
    return found.select(*columns, F.explode(at).alias("_at")).select(*columns, F.col("_at.s").alias(STRETCH), F.col("_at.g").alias(GHOST))


# -- gates ----------------------------------------------------------------------------------------------
def gate_steps(ts: np.ndarray, interval_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of sorted times does to a due time: (upto, after), up to which due time it is left due at which time.

    A due time after all of ``upto`` goes through unchanged.
    """
    n = len(ts)
    if interval_ms < 1:  # every event is a sample
        return ts[-1:], ts[-1:] + interval_ms
    # a stretch is entered due less than an interval after its first time
    starts = np.searchsorted(ts, ts[0] + interval_ms)
    upto, at = np.unique(ts[: starts + 1], return_index=True)
    after = np.zeros(len(upto), np.int64)
    # chain: of the starts whose chains go on, the place in ``at`` where each one stands
    live, chain = np.arange(len(upto)), np.arange(len(upto))
    while len(live):
        due = ts[at] + interval_ms
        then = np.searchsorted(ts, due)
        ended = then == n
        over = ended[chain]
        after[live[over]] = due[chain[over]]
        live, chain = live[~over], chain[~over]
        # chains that meet go on as one
        met = np.full(len(at), -1)
        at, met[~ended] = np.unique(then[~ended], return_inverse=True)
        chain = met[chain]
    return _merged(upto, after)


def _merged(upto: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.r_[after[1:] != after[:-1], True] if len(after) else np.zeros(0, bool)
    return upto[last], after[last]


def applied(due, upto: np.ndarray, after: np.ndarray):
    """The due times that a step function leaves those of an array with."""
    due = np.atleast_1d(np.asarray(due, np.int64))
    place = np.searchsorted(upto, due)
    return np.where(place < len(upto), np.r_[after, 0][np.minimum(place, len(after))], due)


def composed(first: tuple, then: tuple) -> tuple[np.ndarray, np.ndarray]:
    """One step function after another."""
    upto, after = first
    beyond = then[0] > upto[-1] if len(upto) else np.ones(len(then[0]), bool)
    return _merged(np.r_[upto, then[0][beyond]], np.r_[applied(after, *then), then[1][beyond]])


_STEPS = f"{KEY} string, {STRETCH} long, upto array<long>, after array<long>"


def step_tables(times: DataFrame, interval_ms: int) -> DataFrame:
    """(_key, _stretch, upto, after) of each stretch of ``times`` (_key, _stretch, ts): a task holds the times of one."""
    ship_package(times.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []
        for batch in batches:
            keys, numbers, ts = codes(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            opens = np.flatnonzero(np.r_[len(ts) > 0, (keys[1:] != keys[:-1]) | (numbers[1:] != numbers[:-1])]).tolist()
            for at, end in zip(opens, [*opens[1:], len(ts)]):
                own = (batch.column(0)[at].as_py(), int(numbers[at]))
                if own != here:
                    if here is not None:
                        yield _step_rows([(*here, *gate_steps(np.concatenate(parts), interval_ms))])
                    here, parts = own, []
                parts.append(ts[at:end])
        if here is not None:
            yield _step_rows([(*here, *gate_steps(np.concatenate(parts), interval_ms))])

    dealt = times.select(KEY, STRETCH, "ts").repartition(KEY, STRETCH).sortWithinPartitions(KEY, STRETCH, "ts")
    return dealt.mapInArrow(run, _STEPS)


def all_steps(tables: DataFrame, cut: Cuts) -> DataFrame:
    """``tables`` and, for stretches that have none, the function that leaves a due time as it is."""
    none = F.array().cast("array<long>")
    rest = cut.cells.select(KEY, STRETCH).distinct().join(tables.select(KEY, STRETCH), [KEY, STRETCH], "left_anti")
    return tables.unionByName(rest.select(KEY, STRETCH, none.alias("upto"), none.alias("after")))


def _step_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    longs = [pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in columns[2:]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *longs], names=[KEY, STRETCH, "upto", "after"])


def entry_dues(tables: DataFrame, fan: int = FAN, first: int = NEVER) -> DataFrame:
    """(_key, _stretch, due): what the gate is due at when each stretch begins, by a tree of compositions; ``first`` is due before all."""
    ship_package(tables.sparkSession)

    def up(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(STRETCH)
        whole = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for upto, after in zip(parts["upto"], parts["after"]):
            whole = composed(whole, (np.asarray(upto, np.int64), np.asarray(after, np.int64)))
        return pd.DataFrame({KEY: [parts[KEY].iloc[0]], STRETCH: [int(parts[STRETCH].iloc[0]) // fan], "upto": [whole[0]], "after": [whole[1]]})

    def down(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(STRETCH)
        due, dues = np.array([parts["due"].iloc[0]], np.int64), []
        for upto, after in zip(parts["upto"], parts["after"]):
            dues.append(int(due[0]))
            due = applied(due, np.asarray(upto, np.int64), np.asarray(after, np.int64))
        return pd.DataFrame({KEY: parts[KEY], STRETCH: parts[STRETCH], "due": dues})

    parent = F.floor(F.col(STRETCH) / fan).cast("long")
    levels = [written(tables, "gate-steps")]
    while (levels[-1].agg(F.max(STRETCH)).first()[0] or 0) >= fan:
        levels.append(written(levels[-1].groupBy(KEY, parent).applyInPandas(up, _STEPS), "gate-steps"))
    dues = None
    for level in reversed(levels):
        above = level.withColumn("_parent", parent)
        above = above.withColumn("due", F.lit(first)) if dues is None else above.join(dues.select(KEY, F.col(STRETCH).alias("_parent"), "due"), [KEY, "_parent"])
        dues = above.groupBy(KEY, "_parent").applyInPandas(down, f"{KEY} string, {STRETCH} long, due long")
    return dues


# -- samples and baselines --------------------------------------------------------------------------------
_SAMPLE = f"{KEY} string, {STRETCH} long, ts long, seq long, events long, declines long, amount long, full boolean"


def _with_dues(rows: DataFrame, dues: DataFrame) -> DataFrame:
    """``rows`` and, before those of each stretch, a row with what is due."""
    return rows.withColumn("due", F.lit(None).cast("long")).unionByName(dues, allowMissingColumns=True)


def keyed_samples(rows: DataFrame, dues: DataFrame, config: DetectorConfig, detail: bool) -> DataFrame:
    """The samples of stretches of events, and where in a stretch its window first met one event too many."""
    names = [KEY, STRETCH, "due", GHOST, "ts", "seq", "status", "amount_paise", "card_ref", "merchant_id"]
    interval = config.sample_interval_ms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, entity, last, full = None, None, None, False
        for batch in batches:
            out = []
            for k, stretch, due, ghost, ts, seq, status, amount, card, merchant in zip(*(c.to_pylist() for c in batch.columns)):
                if (k, stretch) != here:
                    here, entity, last, full = (k, stretch), Entity(config, detail), None, False
                if due is not None:
                    last = None if due == NEVER else due - interval
                    continue
                over = entity.arrive(ts, status == "declined", amount, card, merchant)
                if ghost:
                    continue
                count = len(entity.window)
                if over and not full:
                    full = True
                    out.append((k, stretch, ts, seq, None, None, None, True))
                if last is None or ts - last >= interval:
                    last = ts
                    out.append((k, stretch, ts, seq, count, entity.declines, entity.amount, False))
            yield _sample_rows(out)

    ordered = _with_dues(rows, dues).select(*names).repartition(KEY, STRETCH).sortWithinPartitions(KEY, STRETCH, F.col("due").isNull(), "ts", "seq")
    return ordered.mapInArrow(run, _SAMPLE)


def first_of_times(rows: DataFrame, interval_ms: int) -> DataFrame:
    """Of ``rows`` (_key, _stretch, ts, seq, events) those that a gate may take: the first of each time, or all if there is no interval."""
    if interval_ms < 1:
        return rows
    return rows.groupBy(KEY, STRETCH, "ts").agg(F.min("seq").alias("seq"), F.min_by("events", "seq").alias("events"))


def counted_samples(rows: DataFrame, dues: DataFrame, interval_ms: int) -> DataFrame:
    """The samples of stretches of rows (_key, _stretch, ts, seq, events) that have their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            due, ts, taken, at = batch.column(2), _numbers(batch.column(3)), [], 0
            for mark in _marks(due):
                # rows between samples are stepped over
                while (at := at if last is None else at + int(np.searchsorted(ts[at:mark], last + interval_ms))) < mark:
                    last = int(ts[at])
                    taken.append(at)
                    at += 1
                if mark < len(ts):
                    last = None if (then := due[mark].as_py()) == NEVER else then - interval_ms
                at = mark + 1
            some, none = batch.take(pa.array(taken, pa.int64())), np.zeros(len(taken), np.int64)
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in (0, 1, 3, 4, 5)), pa.array(none), pa.array(none), pa.array(none > 0)], names=[f.split()[0] for f in _SAMPLE.split(", ")])

    ordered = _with_dues(rows, dues).select(KEY, STRETCH, "due", "ts", "seq", "events").repartition(KEY, STRETCH).sortWithinPartitions(KEY, STRETCH, F.col("due").isNull(), "ts", "seq")
    return ordered.mapInArrow(run, _SAMPLE)


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


def _marks(column: pa.Array) -> list[int]:
    """The rows that have a value, and the end of all."""
    return [*np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist(), len(column)]


def _sample_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=[f.split()[0] for f in _SAMPLE.split(", ")])


def entry_states(samples: DataFrame, dues: DataFrame, config: DetectorConfig, detail: bool, before: dict | None = None) -> DataFrame:
    """(_key, _stretch, _state): what each stretch starts from; a key's samples are read in order, one per gate interval at most.

    ``before`` is the state that a key had before all, if any.
    """
    ship_package(samples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entity = None, None
        for batch in batches:
            out = []
            for k, stretch, due, events, declines, amount, full in zip(*(c.to_pylist() for c in batch.columns)):
                if entity is None or k != key:
                    key, entity = k, Entity.load(before, config, detail) if before else Entity(config, detail)
                if due is not None:
                    entity.last = None if due == NEVER else due - config.sample_interval_ms
                    out.append((k, stretch, entity.save()))
                elif full:
                    entity.full = True
                else:
                    entity.learn(events, declines, amount)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], STATE_ARROW)], names=[KEY, STRETCH, RESUME])

    ordered = _with_dues(samples, dues).repartition(KEY).sortWithinPartitions(KEY, STRETCH, F.col("due").isNull(), "ts", "seq").select(KEY, STRETCH, "due", "events", "declines", "amount", "full")
    return ordered.mapInArrow(run, T.StructType([T.StructField(KEY, T.StringType()), T.StructField(STRETCH, T.LongType()), T.StructField(RESUME, STATE)]))


# -- folds ------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Plan:
    """What is known of the hot keys of an axis before their rows are folded."""

    cut: Cuts
    states: DataFrame


def prepared(events: DataFrame, axis: str, config: DetectorConfig, detail: bool, hot: int = HOT) -> Plan | None:
    """The stretches and entry states of keys of over ``hot`` events, from the bare events; none if there is no such key."""
    keys = written(busy_keys(events, axis, hot), "busy-keys")
    if keys.isEmpty():
        return None
    bare = events.select(F.col(axis).alias(KEY), "ts", "seq", "status", "amount_paise", "card_ref", "merchant_id").join(keys.select(KEY), KEY, "left_semi")
    cut = cuts(bare, keys, hot, config.window_ms)
    rows = placed(bare, cut, config.window_ms)
    dues = written(entry_dues(step_tables(rows.filter(~F.col(GHOST)), config.sample_interval_ms)), "gate-dues")
    samples = written(keyed_samples(rows, dues, config, detail), "fold-samples")
    return Plan(cut, written(entry_states(samples, dues, config, detail), "fold-states"))


def split_fold(events: DataFrame, axis: str, config: DetectorConfig, prefix: str, detail: bool, plan: Plan | None) -> DataFrame:
    """``entity_fold``, the hot keys of a plan being folded stretch by stretch."""
    if plan is None:
        return entity_fold(events, axis, config, prefix, detail)
    keys = plan.cut.keys.select(F.col(KEY).alias(axis))
    cold = entity_fold(events.join(keys, axis, "left_anti").select(*events.columns), axis, config, prefix, detail)
    rows = placed(events.withColumn(KEY, F.col(axis)), plan.cut, config.window_ms).withColumn(RESUME, F.lit(None).cast(STATE))
    hot = resumed_fold(rows.unionByName(plan.states, allowMissingColumns=True), [KEY, STRETCH], events.columns, config, prefix, detail)
    return cold.unionByName(hot)


def with_unkeyed_baseline(rows: DataFrame, counts: str, config: DetectorConfig, size: int, prefix: str = "all", before: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the baseline of a count over the whole stream, as it was before each row; and (_state) after them all.

    Up to ``size`` rows are one stretch; more are cut, so that no task reads them all.  ``rows`` are read several times.
    ``before`` is the state to start from, of a stream that goes on.
    """
    ship_package(rows.sparkSession)
    interval = config.sample_interval_ms
    first = NEVER if before is None or before["last"] is None else before["last"] + interval
    keyed = rows.withColumn(KEY, F.lit("all"))
    total = keyed.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    cut = cuts(keyed, total, size, 1)
    own = placed(keyed, cut)
    # read for the gates and for the samples, and for neither more than once for each time
    firsts = written(first_of_times(own.select(KEY, STRETCH, "ts", "seq", F.col(counts).alias("events")), interval), "gate-times")
    dues = written(entry_dues(step_tables(firsts, interval), first=first), "gate-dues")
    samples = written(counted_samples(firsts, dues, interval), "fold-samples")
    # behind all stretches: what is due once they are over
    end = samples.agg((F.max("ts") + interval).alias("due")).select(F.lit("all").alias(KEY), F.lit(END).alias(STRETCH), F.coalesce("due", F.lit(first)).alias("due"))
    states = written(entry_states(samples, dues.unionByName(end), config, False, before), "fold-states")
    full = own.drop(GHOST).withColumn(RESUME, F.lit(None).cast(STATE)).unionByName(states, allowMissingColumns=True)
    return _carried(full, [KEY, STRETCH], rows.columns, counts, config, prefix), states.filter(F.col(STRETCH) == END).select(RESUME)


def with_unkeyed_baseline_in_one(rows: DataFrame, counts: str, config: DetectorConfig, prefix: str = "all") -> DataFrame:
    """The same of a stream so short that one task may read it all."""
    ship_package(rows.sparkSession)
    keyed = rows.withColumns({KEY: F.lit("all"), RESUME: F.lit(None).cast(STATE)})
    return _carried(keyed, [KEY], rows.columns, counts, config, prefix)


def _carried(full: DataFrame, group: list[str], columns: list[str], counts: str, config: DetectorConfig, prefix: str) -> DataFrame:
    """``columns`` with the unkeyed baseline, carried through each group in order; a row with a state is where it starts."""
    names = full.columns
    at = [names.index(c) for c in (RESUME, "ts", counts)]
    kept_at = [names.index(c) for c in columns]
    added = [T.StructField(f"{prefix}_samples", T.LongType()), T.StructField(f"{prefix}_mean", T.DoubleType()), T.StructField(f"{prefix}_spread", T.DoubleType())]
    interval, out_names = config.sample_interval_ms, [*columns, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity = Entity(config, False)
        for batch in batches:
            state, ts, count = batch.column(at[0]), _numbers(batch.column(at[1])), _numbers(batch.column(at[2]))
            known = [np.zeros(len(ts), np.int64), np.zeros(len(ts)), np.zeros(len(ts))]
            begin = 0
            for mark in _marks(state):
                while begin < mark:
                    # what is known is the same up to the next sample, that row included
                    sample = begin if entity.last is None else begin + int(np.searchsorted(ts[begin:mark], entity.last + interval))
                    end = min(sample + 1, mark)
                    for column, value in zip(known, entity.known()):
                        column[begin:end] = value
                    if sample < mark:
                        entity.last = int(ts[sample])
                        entity.learn(int(count[sample]), 0, 0)
                    begin = end
                if mark < len(ts):
                    entity = Entity.load(json.loads(state[mark].as_py()), config, False)
                begin = mark + 1
            full = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_at), *(pa.array(k) for k in known)], names=out_names)
            yield full.filter(state.is_null()) if state.null_count < len(ts) else full

    dealt = as_text(full).repartition(*group).sortWithinPartitions(*group, F.col(RESUME).isNull(), "ts", "seq")
    return dealt.mapInArrow(run, T.StructType([*(full.schema[c] for c in columns), *added]))
