"""The keyed fold: windows and gated baselines of every entity in one sorted pass.

Rows are dealt by entity, sorted by (entity, ts, seq) and read batch by batch; only the entity at
hand has state (a ring of at most ``capacity`` events and a few sums), so a hot entity needs no
more memory than a cold one.  All input columns pass through, which makes folds chain: one
exchange per axis and no join.

``Entity`` takes one event at a time; ``Slices`` takes a batch of many entities at once and gives the same numbers to the last bit:
windows are ranges of rows, their sums are differences of running sums, distinct cards are visits begun
less visits over, and baselines are learned for all entities of the batch side by side.

A baseline takes a sample only if the gate's interval has gone by since its last one, and an
event is compared with the baseline as it was before the event.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import DetectorConfig
from tidemark.session import ship_package

_COUNTS = [("events", T.LongType()), ("samples", T.LongType()), ("mean", T.DoubleType()), ("spread", T.DoubleType()), ("ewma", T.DoubleType()), ("gated", T.BooleanType())]
_DETAIL = [("declines", T.LongType()), ("amount", T.LongType()), ("cards", T.LongType()), ("merchants", T.LongType()), ("saturated", T.BooleanType()), ("base_ratio", T.DoubleType()), ("base_amount", T.DoubleType())]
_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}


def alpha(halflife: float) -> float:
    return 1.0 - math.exp(-math.log(2.0) / max(halflife, 1e-9))


class Entity:
    """State of one entity; ``step`` takes an event and says what stood before and with it."""

    __slots__ = ("config", "detail", "window", "declines", "amount", "cards", "merchants", "full", "last", "n", "mean", "m2", "ewma", "ratio", "size", "rate")

    def __init__(self, config: DetectorConfig, detail: bool):
        self.config, self.detail, self.rate = config, detail, alpha(config.halflife_samples)
        self.window: deque = deque()
        self.declines = self.amount = self.n = 0
        self.cards: dict[str, int] = {}
        self.merchants: dict[str, int] = {}
        self.full, self.last = False, None
        self.mean = self.m2 = self.ewma = self.ratio = self.size = 0.0

    def _drop(self) -> None:
        _, declined, amount, card, merchant = self.window.popleft()
        if not self.detail:
            return
        self.declines -= declined
        self.amount -= amount
        for held, value in ((self.cards, card), (self.merchants, merchant)):
            if held[value] == 1:
                del held[value]
            else:
                held[value] -= 1

    def arrive(self, ts: int, declined: int, amount: int, card: str, merchant: str) -> bool:
        """Take an event into the window; whether that was full."""
        window, cutoff = self.window, ts - self.config.window_ms
        while window and window[0][0] <= cutoff:
            self._drop()
        over = len(window) >= self.config.ring_capacity
        if over:
            self._drop()
        window.append((ts, declined, amount, card, merchant))
        if self.detail:
            self.declines += declined
            self.amount += amount
            self.cards[card] = self.cards.get(card, 0) + 1
            self.merchants[merchant] = self.merchants.get(merchant, 0) + 1
        return over

    def known(self) -> tuple:
        """The baseline: samples, mean, spread, weighted mean, and with detail ratio and size."""
        return (self.n, self.mean, math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0, self.ewma, self.ratio, self.size)

    def learn(self, count: int, declines: int, amount: int) -> None:
        """Take a sample of the window into the baseline."""
        self.n += 1
        off = count - self.mean
        self.mean += off / self.n
        self.m2 += off * (count - self.mean)
        self.ewma = float(count) if self.n == 1 else self.ewma + self.rate * (count - self.ewma)
        if self.detail:
            self.ratio += (declines / count - self.ratio) / self.n
            self.size += (amount / count - self.size) / self.n

    def step(self, ts: int, declined: int, amount: int, card: str, merchant: str) -> tuple:
        if self.arrive(ts, declined, amount, card, merchant):
            self.full = True
        count, n = len(self.window), self.n
        spread = math.sqrt(self.m2 / (n - 1)) if n > 1 else 0.0
        gated = self.last is None or ts - self.last >= self.config.sample_interval_ms
        seen = (count, n, self.mean, spread, self.ewma, gated)
        if self.detail:
            seen += (self.declines, self.amount, len(self.cards), len(self.merchants), self.full, self.ratio, self.size)
        if gated:
            self.last = ts
            self.learn(count, self.declines, self.amount)
        return seen

    def reset(self) -> None:
        """Back to the state of an entity that has seen nothing."""
        self.__init__(self.config, self.detail)

    def save(self) -> dict:
        """All of the state as a row of ``STATE``, for a warm start without a replay."""
        kept = {name: getattr(self, name) for name in _SAVED}
        return kept | {"held": [dict(zip(_HELD, (ts, bool(declined), amount or 0, card or "", merchant or ""))) for ts, declined, amount, card, merchant in self.window]}

    @classmethod
    def load(cls, saved: dict, config: DetectorConfig, detail: bool) -> Entity:
        out = cls(config, detail)
        for name in _SAVED:
            setattr(out, name, saved[name])
        full = out.full
        for event in saved["held"]:
            out.arrive(*(event[name] for name in _HELD))
        out.full = full
        return out


class Span:
    """The events of a key over a long span and their cards, without a capacity."""

    __slots__ = ("reach", "held", "cards")

    def __init__(self, span_ms: int, closed: bool, held: Iterator[tuple[int, str]] = ()):
        """``closed``: [t - span, t]; else (t - span, t]."""
        self.reach = span_ms if closed else span_ms - 1
        self.held: deque = deque(held)
        self.cards: dict[str, int] = {}
        for _, card in self.held:
            self.cards[card] = self.cards.get(card, 0) + 1

    def step(self, ts: int, card: str) -> tuple[int, int]:
        """(events, distinct cards) with this event, which is the latest."""
        held, cards = self.held, self.cards
        held.append((ts, card))
        cards[card] = cards.get(card, 0) + 1
        while held[0][0] < ts - self.reach:
            old = held.popleft()[1]
            if cards[old] == 1:
                del cards[old]
            else:
                cards[old] -= 1
        return len(held), len(cards)


_HELD = ("ts", "declined", "amount", "card", "merchant")
_SAVED = ("full", "last", "n", "mean", "m2", "ewma", "ratio", "size")
#: What is kept of an entity: its window's events, its gate and its baselines.
STATE = T.StructType(
    [
        T.StructField("held", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in zip(_HELD, (T.LongType(), T.BooleanType(), T.LongType(), T.StringType(), T.StringType()))]))),
        T.StructField("full", T.BooleanType()),
        T.StructField("last", T.LongType()),
        T.StructField("n", T.LongType()),
        *(T.StructField(n, T.DoubleType()) for n in ("mean", "m2", "ewma", "ratio", "size")),
    ]
)
STATE_ARROW = pa.struct([("held", pa.list_(pa.struct([("ts", pa.int64()), ("declined", pa.bool_()), ("amount", pa.int64()), ("card", pa.string()), ("merchant", pa.string())]))), ("full", pa.bool_()), ("last", pa.int64()), ("n", pa.int64()), *((n, pa.float64()) for n in ("mean", "m2", "ewma", "ratio", "size"))])
#: Columns of rows that a fold resumes from, and of rows that enter windows only.
RESUME, GHOST = "_state", "_ghost"


def as_text(rows: DataFrame) -> DataFrame:
    """``rows`` with their states as JSON: a batch on its way to Python is measured row by row, and a struct's many vectors cost more than the row."""
    return rows.withColumn(RESUME, F.to_json(RESUME, {"ignoreNullFields": "false"}))


def fields(prefix: str, detail: bool) -> list[T.StructField]:
    return [T.StructField(f"{prefix}_{name}", kind) for name, kind in (_COUNTS + _DETAIL if detail else _COUNTS)]


def codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class Slices:
    """The fold of sorted batches; the last entity of one may go on in the next."""

    #: Entities that learn side by side, at least; fewer are taken one by one.
    SIDE_BY_SIDE = 24

    def __init__(self, config: DetectorConfig, detail: bool):
        self.config, self.detail, self.rate = config, detail, alpha(config.halflife_samples)
        self.key = None
        self.tail: tuple | None = None  # (ts, declined, amount, cards, merchants) of the window at the last row
        self.entity = Entity(config, detail)

    def _distinct(self, column: pa.Array, part: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Distinct values from ``start`` to each row: visits begun by then, less those over before."""
        n = len(start)
        value = codes(column)
        both = part * (value.max(initial=0) + 2) + value + 1
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        before = np.full(n, -1)
        before[order[1:][same]] = order[:-1][same]
        fresh = before < start
        over = np.ones(n, bool)
        over[order[:-1][same]] = fresh[order[1:][same]]
        begun, ended = np.cumsum(fresh), np.r_[0, np.cumsum(over)]
        return begun - ended[start]

    def take(self, entities: pa.Array, ts: np.ndarray, declined: np.ndarray | None, amount: np.ndarray | None, cards: pa.Array | None, merchants: pa.Array | None) -> list[np.ndarray]:
        """The columns of ``fields`` for the rows of a batch."""
        c, n = self.config, len(ts)
        reach = max(c.window_ms, c.sample_interval_ms, 0)
        if n > 1 and (int(ts.max()) - int(ts.min()) + 2 * reach) * n >= 1 << 61:  # too far apart for one line of time
            half = n // 2
            parts = [[x[:half] if k == 0 else x[half:] for x in (entities, ts, declined, amount, cards, merchants) if x is not None] for k in (0, 1)]
            done = [self.take(*p, *[None] * (6 - len(p))) for p in parts]
            return [np.concatenate(x) for x in zip(*done)]
        first_key = entities[0].as_py()
        goes_on = self.tail is not None and first_key == self.key
        if not goes_on:
            self.entity, self.tail = Entity(c, self.detail), None
        code = codes(entities)
        skip = len(self.tail[0]) if goes_on else 0
        if skip:
            ts = np.r_[self.tail[0], ts]
            code = np.r_[np.full(skip, code[0]), code]
            if self.detail:
                declined, amount = np.r_[self.tail[1], declined], np.r_[self.tail[2], amount]
                cards, merchants = pa.concat_arrays([self.tail[3], cards]), pa.concat_arrays([self.tail[4], merchants])
        total = len(ts)
        row = np.arange(total)
        opens = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        part = np.repeat(np.arange(len(opens)), np.diff(np.r_[opens, total]))
        closes = np.r_[opens[1:], total]
        # times of all entities in one ascending line: each has a stretch of its own, wider than any reach
        low = int(ts.min())
        wide = int(ts.max()) - low + reach + 1
        line = part * wide + (ts - low)
        by_time = np.searchsorted(line, line - c.window_ms, side="right")
        over = by_time <= row - c.ring_capacity
        start = np.maximum(by_time, row - c.ring_capacity + 1)
        count = row - start + 1
        declines = sums = None
        if self.detail:
            d, a = np.r_[0, np.cumsum(declined)], np.r_[0, np.cumsum(amount)]
            declines, sums = d[row + 1] - d[start], a[row + 1] - a[start]
        at, states, due = self._learned(line, ts, part, opens, closes, skip, count, declines, sums)
        # the state before a row: that of its entity's beginning, or after the last sample before the row
        seen = np.searchsorted(at, 2 * row[skip:], side="right") - 1
        samples, mean, m2, ewma, ratio, size, _ = (x[seen] for x in states)
        spread = np.sqrt(np.divide(m2, samples - 1, out=np.zeros(n), where=samples > 1))
        gated = np.zeros(total, bool)
        gated[at[at % 2 == 1] // 2] = True
        out = [count[skip:], samples.astype(np.int64), mean, spread, ewma, gated[skip:]]
        met = np.r_[0, np.cumsum(over)]
        full = met[row + 1] > met[np.maximum(opens[part], skip)]
        if self.entity.full:
            full[part == 0] = True
        if self.detail:
            out += [declines[skip:], sums[skip:], self._distinct(cards, part, start)[skip:], self._distinct(merchants, part, start)[skip:], full[skip:], ratio, size]
        self._keep(entities, ts, declined, amount, cards, merchants, start[-1], bool(full[-1]), [x[-1] for x in states], due, len(opens) > 1)
        return out

    def _learned(self, line, ts, part, opens, closes, skip, count, declines, sums) -> tuple:
        """(2 * row for an entity's beginning or 2 * row + 1 for a sample, states from there on, when the last entity sampled)."""
        c, e = self.config, self.entity
        entities = len(opens)
        state = [np.zeros(entities) for _ in range(6)]  # n, mean, m2, ewma, ratio, size
        for x, v in zip(state, (e.n, e.mean, e.m2, e.ewma, e.ratio, e.size)):
            x[0] = v
        here = opens.copy()
        here[0] = skip
        if e.last is not None:
            here[0] = max(skip, int(np.searchsorted(ts[: closes[0]], e.last + c.sample_interval_ms)))
        marks, found = [2 * opens], [[x.copy() for x in state] + [np.arange(entities)]]
        marks[0][0] = 2 * skip
        live = np.flatnonzero(here < closes)
        every = c.sample_interval_ms < 1
        last_sample = e.last if entities == 1 else None
        while len(live) >= self.SIDE_BY_SIDE:
            at = here[live]
            n, mean, m2, ewma, ratio, size = (x[live] for x in state)
            k = count[at].astype(float)
            n = n + 1
            off = k - mean
            mean = mean + off / n
            m2 = m2 + off * (k - mean)
            ewma = np.where(n == 1, k, ewma + self.rate * (k - ewma))
            if self.detail:
                ratio = ratio + (declines[at] / k - ratio) / n
                size = size + (sums[at] / k - size) / n
            new = [n, mean, m2, ewma, ratio, size]
            for x, v in zip(state, new):
                x[live] = v
            marks.append(2 * at + 1)
            found.append([*new, live])
            if live[-1] == entities - 1:
                last_sample = int(ts[at[-1]])
            here[live] = at + 1 if every else np.searchsorted(line, line[at] + c.sample_interval_ms)
            live = live[here[live] < closes[live]]
        rows = []
        for p in live.tolist():
            one = Entity(c, self.detail)
            one.n = int(state[0][p])
            one.mean, one.m2, one.ewma, one.ratio, one.size = (float(x[p]) for x in state[1:])
            at, end, begin = int(here[p]), int(closes[p]), int(opens[p])
            times = ts[begin:end]
            while at < end:
                one.learn(int(count[at]), int(declines[at]) if self.detail else 0, int(sums[at]) if self.detail else 0)
                rows.append((2 * at + 1, one.n, one.mean, one.m2, one.ewma, one.ratio, one.size, p))
                if p == entities - 1:
                    last_sample = int(ts[at])
                at = at + 1 if every else begin + int(np.searchsorted(times, ts[at] + c.sample_interval_ms))
        if rows:
            columns = list(zip(*rows))
            marks.append(np.array(columns[0], np.int64))
            found.append([*(np.array(v, float) for v in columns[1:7]), np.array(columns[7])])
        mark = np.concatenate(marks)
        order = np.argsort(mark, kind="stable")
        return mark[order], [np.concatenate(v)[order] for v in zip(*found)], last_sample

    def _keep(self, entities, ts, declined, amount, cards, merchants, start, full, state, last, changed) -> None:
        self.key = entities[-1].as_py()
        self.tail = (ts[start:], declined[start:], amount[start:], cards[int(start) :], merchants[int(start) :]) if self.detail else (ts[start:],)
        e = self.entity = Entity(self.config, self.detail)
        e.n, e.mean, e.m2, e.ewma, e.ratio, e.size = int(state[0]), *(float(x) for x in state[1:6])
        e.full, e.last = full, last


def entity_fold(events: DataFrame, axis: str, config: DetectorConfig, prefix: str, detail: bool) -> DataFrame:
    """``events`` with the entity's window and baseline columns, named by ``prefix``."""
    ship_package(events.sparkSession)
    added = fields(prefix, detail)
    names = events.columns
    at = {c: names.index(c) for c in (axis, "ts", "status", "amount_paise", "card_ref", "merchant_id")}
    kinds = [_ARROW[type(f.dataType)] for f in added]
    out_names = [*names, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = Slices(config, detail)
        for batch in batches:
            if not batch.num_rows:
                continue
            ts = batch.column(at["ts"]).to_numpy()
            rest = (None, None, None, None)
            if detail:
                declined = pc.equal(batch.column(at["status"]), "declined").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64)
                rest = (declined, batch.column(at["amount_paise"]).to_numpy(), batch.column(at["card_ref"]), batch.column(at["merchant_id"]))
            columns = slices.take(batch.column(at[axis]), ts, *rest)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, kind) for v, kind in zip(columns, kinds))], names=out_names)

    dealt = events.repartition(axis).sortWithinPartitions(axis, "ts", "seq")
    return dealt.mapInArrow(run, T.StructType([*events.schema.fields, *added]))


def resumed_fold(rows: DataFrame, group: list[str], columns: list[str], config: DetectorConfig, prefix: str, detail: bool) -> DataFrame:
    """``columns`` of ``rows`` with the columns of ``entity_fold``, each group starting from its row with a state.

    A row with ``_state`` stands for what came before the group and isn't given back, nor is a row with ``_ghost``, which enters windows alone.
    """
    ship_package(rows.sparkSession)
    added = fields(prefix, detail)
    names = rows.columns
    of = [names.index(c) for c in group]
    at = [names.index(c) for c in ("ts", "status", "amount_paise", "card_ref", "merchant_id")]
    state_at, ghost_at, kept_at = names.index(RESUME), names.index(GHOST), [names.index(c) for c in columns]
    kinds = [_ARROW[type(f.dataType)] for f in added]
    out_names = [*columns, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entity = None, None
        for batch in batches:
            out, kept = [], []
            keys = list(zip(*(batch.column(c).to_pylist() for c in of)))
            states, ghosts = batch.column(state_at).to_pylist(), batch.column(ghost_at).to_pylist()
            for i, (k, state, ghost, ts, status, amount, card, merchant) in enumerate(zip(keys, states, ghosts, *(batch.column(c).to_pylist() for c in at))):
                if entity is None or k != key:
                    key, entity = k, Entity(config, detail)
                if state is not None:
                    entity = Entity.load(json.loads(state), config, detail)
                elif ghost:
                    entity.arrive(ts, status == "declined", amount, card, merchant)
                else:
                    kept.append(i)
                    out.append(entity.step(ts, status == "declined", amount, card, merchant))
            values = zip(*out) if out else [[] for _ in added]
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept_at), *(pa.array(list(v), kind) for v, kind in zip(values, kinds))], names=out_names)

    dealt = as_text(rows).repartition(*group).sortWithinPartitions(*group, F.col(RESUME).isNull(), "ts", "seq")
    return dealt.mapInArrow(run, T.StructType([*(rows.schema[c] for c in columns), *added]))


def _from_states(events: DataFrame, axis: str, states: DataFrame | None) -> DataFrame:
    """``events`` and the states of a table (axis, state) as rows among them."""
    marked = events.withColumns({RESUME: F.lit(None).cast(STATE), GHOST: F.lit(False)})
    if states is None:
        return marked
    return marked.unionByName(states.select(axis, F.col("state").cast(STATE).alias(RESUME)), allowMissingColumns=True)


def warm_fold(events: DataFrame, axis: str, config: DetectorConfig, prefix: str, detail: bool, states: DataFrame | None) -> DataFrame:
    """``entity_fold`` of entities that go on from a table (axis, state); one that isn't in it starts anew.

    To reset an entity is to leave its row out of the table.
    """
    return resumed_fold(_from_states(events, axis, states), [axis], events.columns, config, prefix, detail)


def end_states(events: DataFrame, axis: str, config: DetectorConfig, states: DataFrame | None = None) -> DataFrame:
    """(axis, state): what every entity is left with after ``events``, having started from ``states``.

    An entity of ``states`` without an event keeps its row.
    """
    ship_package(events.sparkSession)
    rows = _from_states(events.select(axis, "ts", "seq", "status", "amount_paise", "card_ref", "merchant_id"), axis, states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entity = None, None
        for batch in batches:
            done = []
            for k, ts, _, status, amount, card, merchant, state, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if entity is None or k != key:
                    if entity is not None:
                        done.append((key, entity.save()))
                    key, entity = k, Entity(config, True)
                if state is not None:
                    entity = Entity.load(json.loads(state), config, True)
                else:
                    entity.step(ts, status == "declined", amount, card, merchant)
            yield _state_rows(done)
        if entity is not None:
            yield _state_rows([(key, entity.save())])

    def _state_rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([s for _, s in done], STATE_ARROW)], names=[axis, "state"])

    dealt = as_text(rows).repartition(axis).sortWithinPartitions(axis, F.col(RESUME).isNull(), "ts", "seq")
    return dealt.mapInArrow(run, T.StructType([T.StructField(axis, T.StringType()), T.StructField("state", STATE)]))


def trailing_fold(events: DataFrame, keys: list[str], span_ms: int, closed: bool, prefix: str) -> DataFrame:
    """``events`` with the events and distinct cards of ``keys`` over a long span, in one sorted pass.

    ``closed``: [t - span, t]; else (t - span, t].  State is what the span holds of one key, and an
    event enters and leaves it once, however long the span is.
    """
    ship_package(events.sparkSession)
    names = events.columns
    at = [names.index(c) for c in (*keys, "ts", "card_ref")]
    added = [T.StructField(f"{prefix}_events", T.LongType()), T.StructField(f"{prefix}_cards", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, span = None, None
        for batch in batches:
            out = []
            for *here, ts, card in zip(*(batch.column(c).to_pylist() for c in at)):
                if span is None or here != key:
                    key, span = here, Span(span_ms, closed)
                out.append(span.step(ts, card))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))], names=[*names, *(f.name for f in added)])

    dealt = events.repartition(*keys).sortWithinPartitions(*keys, "ts", "seq")
    return dealt.mapInArrow(run, T.StructType([*events.schema.fields, *added]))
