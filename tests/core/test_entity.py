"""Properties of one entity's state, on arbitrary streams."""

import math
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.model import DetectorConfig
from tidemark.operators.fold import Entity, Slices, alpha

EVENT = st.tuples(st.integers(0, 3000), st.booleans(), st.integers(0, 10**6), st.sampled_from("abcde"), st.sampled_from("xyz"))


@settings(max_examples=150, deadline=None)
@given(st.lists(EVENT, max_size=120), st.integers(1, 6), st.integers(1, 4000), st.integers(0, 3000))
def test_step_is_a_recount(events, capacity, window, gate):
    config = DetectorConfig(window_ms=window, ring_capacity=capacity, sample_interval_ms=gate, halflife_samples=2.0)
    entity, held, t, full = Entity(config, True), [], 0, False
    counts, ratios, sizes, last = [], [], [], None
    for step, declined, amount, card, merchant in events:
        t += step
        held = [e for e in held if e[0] > t - window]
        full |= len(held) == capacity
        held = [*held, (t, declined, amount, card, merchant)][-capacity:]
        n, samples, mean, spread, ewma, gated, declines, total, cards, merchants, saturated, ratio, size = entity.step(t, declined, amount, card, merchant)
        assert (n, declines, total) == (len(held), sum(e[1] for e in held), sum(e[2] for e in held))
        assert (cards, merchants, saturated) == (len({e[3] for e in held}), len({e[4] for e in held}), full)
        assert n <= capacity and samples == len(counts)
        centre = sum(counts) / len(counts) if counts else 0.0
        deviation = math.sqrt(sum((c - centre) ** 2 for c in counts) / (len(counts) - 1)) if len(counts) > 1 else 0.0
        smooth = counts[0] if counts else 0.0
        for c in counts[1:]:
            smooth += alpha(2.0) * (c - smooth)
        for a, b in ((mean, centre), (spread, deviation), (ewma, smooth), (ratio, sum(ratios) / len(ratios) if ratios else 0.0), (size, sum(sizes) / len(sizes) if sizes else 0.0)):
            assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)
        assert gated == (last is None or t - last >= gate)
        if gated:
            last = t
            counts.append(n)
            ratios.append(declines / n)
            sizes.append(total / n)


def test_large_offsets_keep_their_variance():
    entity = Entity(DetectorConfig(window_ms=1, ring_capacity=2, sample_interval_ms=0), False)
    for i in range(1000):
        seen = entity.step(i * 10, 0, 0, "", "")
    assert seen[2] == 1.0 and seen[3] == 0.0  # constant counts: no spread


def test_saved_state_and_reset():
    """A baseline that was saved and loaded goes on as if nothing had been; reset forgets all."""
    config = DetectorConfig(sample_interval_ms=1000, window_ms=5000, ring_capacity=8)
    rng = random.Random(4)
    events, ts = [], 0
    for _ in range(300):
        ts += rng.randrange(0, 1500)
        events.append((ts, rng.randrange(2), rng.randrange(1, 900), f"c{rng.randrange(9)}", f"m{rng.randrange(3)}"))
    whole, first = Entity(config, True), Entity(config, True)
    for e in events[:150]:
        whole.step(*e)
        first.step(*e)
    second = Entity.load(first.save(), config, True)
    assert [whole.step(*e) for e in events[150:]] == [second.step(*e) for e in events[150:]]
    second.reset()
    fresh = Entity(config, True)
    assert [second.step(*e) for e in events] == [fresh.step(*e) for e in events]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3000), st.booleans(), st.integers(0, 10**6), st.sampled_from("abcde"), st.sampled_from("xyz")), min_size=1, max_size=150),
    st.integers(1, 6), st.integers(1, 4000), st.integers(0, 3000), st.lists(st.integers(1, 150), max_size=5), st.sampled_from([1, 3, 99]), st.booleans(),
)
def test_slices_are_steps(events, capacity, window, gate, cuts, side, detail):
    """Whole batches at once have the numbers of one event after another, however the rows fall into batches."""
    config = DetectorConfig(window_ms=window, ring_capacity=capacity, sample_interval_ms=gate, halflife_samples=2.0)
    rows, want, entity, t = sorted((e[0], i, *e[1:]) for i, e in enumerate(events)), [], {}, {}
    timed = []
    for key, _, step, declined, amount, card, merchant in rows:
        t[key] = t.get(key, key * 977) + step
        timed.append((f"k{key}", t[key], declined, amount, card, merchant))
        one = entity.setdefault(key, Entity(config, detail))
        want.append(one.step(t[key], declined, amount, card, merchant))
    slices, got = Slices(config, detail), []
    slices.SIDE_BY_SIDE = side
    bounds = sorted({0, len(timed), *(c for c in cuts if c < len(timed))})
    for a, b in zip(bounds, bounds[1:]):
        columns = list(zip(*timed[a:b]))
        rest = (np.array(columns[2], np.int64), np.array(columns[3], np.int64), pa.array(columns[4]), pa.array(columns[5])) if detail else (None,) * 4
        got += list(zip(*(x.tolist() for x in slices.take(pa.array(columns[0]), np.array(columns[1], np.int64), *rest))))
    assert got == want


def test_slices_of_times_far_apart():
    config = DetectorConfig()
    ts = [-(2**60), 0, 1000, 2**60, 2**60 + 500]
    one = Entity(config, False)
    want = [one.step(t, 0, 0, "", "") for t in ts]
    got = Slices(config, False).take(pa.array(["k"] * 5), np.array(ts, np.int64), None, None, None, None)
    assert list(zip(*(x.tolist() for x in got))) == want
