"""Synthetic authorization streams: benign traffic of merchants, and scheduled episodes.

Traffic is drawn where it is used: a row per (merchant, day) or per episode goes to the executors
and comes back as events, each with a random stream of its own, spawned from the seed and the
row's key.  So the result doesn't depend on partitioning, a lost task redraws the same events, and
a changed episode changes no other.  Only the schedule and the merchants are made on the driver.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import ATTACKS, DAY_MS, EVENT_SCHEMA, HOUR_MS
from tidemark.session import ship_package
from tidemark.sources.files import with_txn_ids

START_MS = 1_767_225_600_000
LOCAL_OFFSET_MS = 19_800_000  # five and a half hours east
#: Width of the day's peak, and evenness of the pauses between episodes.
BELL_HOURS, PAUSE_SHAPE = 6.0, 8.0


#: The defaults are those of the stream that published figures are about.
@dataclass(frozen=True)
class StreamConfig:
    seed: int = 20_260_824
    total_days: int = 100
    train_days: int = 50
    merchants: int = 10
    hourly_rate: tuple[float, float] = (18.0, 72.0)
    decline_rate: tuple[float, float] = (0.045, 0.115)
    amount_median: tuple[int, int] = (45_000, 320_000)
    amount_sigma: tuple[float, float] = (0.55, 1.05)
    amount_bounds: tuple[int, int] = (1_000, 5_000_000)
    diurnal: tuple[float, float, float] = (0.28, 1.95, 20.5)  # trough, peak, hour of the peak
    weekend: float = 1.18
    cards: int = 9_000
    ips: int = 6_500
    devices: int = 5_200
    bins: int = 220
    reuse_exponent: float = 1.35
    bin_exponent: float = 0.65
    newcomers: float = 0.25
    episodes_per_day: float = 0.40


#: Ranges of the six kinds of episode (minutes, events, cards, ips and devices per
#: event, decline ratio, amounts, merchants).
TEMPLATES = {
    "burst": ((9.0, 15.0), (190, 300), (1.0, 1.0), (0.004, 0.006), (0.004, 0.006), (0.83, 0.89), (100, 6_000), (1, 1)),
    "rotating": ((22.0, 31.0), (205, 285), (1.0, 1.0), (0.20, 0.27), (0.19, 0.25), (0.81, 0.86), (100, 6_000), (1, 1)),
    "slow_low": ((330.0, 420.0), (48, 66), (1.0, 1.0), (0.045, 0.08), (0.045, 0.07), (0.69, 0.75), (100, 4_000), (1, 1)),
    "flash_sale": ((45.0, 60.0), (760, 1_020), (0.96, 0.99), (0.92, 0.94), (0.89, 0.92), (0.14, 0.17), (15_000, 900_000), (1, 1)),
    "issuer_outage": ((55.0, 78.0), (760, 1_050), (0.30, 0.34), (0.29, 0.32), (0.28, 0.31), (0.79, 0.86), (1_000, 500_000), (4, 5)),
    "outage_single_merchant": ((55.0, 78.0), (760, 1_050), (0.18, 0.24), (0.17, 0.22), (0.16, 0.21), (0.79, 0.86), (100, 6_000), (1, 1)),
}


def rng_of(seed: int, *key) -> np.random.Generator:
    """A stream of its own for each key."""
    return np.random.default_rng([seed, *(zlib.crc32(str(k).encode()) for k in key)])


def zipf(size: int, exponent: float) -> np.ndarray:
    weights = np.arange(1, size + 1, dtype=float) ** -exponent
    return weights / weights.sum()


def bin_name(k: np.ndarray, seed: int) -> list[str]:
    """Distinct six-digit names with a leading nought: a fixed shuffle of the numbers."""
    order = rng_of(seed, "bins").permutation(100_000)
    return [f"0{order[i]:05d}" for i in k]


def ip_name(k: np.ndarray) -> list[str]:
    """Addresses in the block reserved for benchmarks; beyond it they come round again."""
    return [f"198.{18 + (i % 131_072 >> 16)}.{i >> 8 & 255}.{i & 255}" for i in np.asarray(k, dtype=np.int64).tolist()]


def merchant_table(config: StreamConfig) -> list[dict]:
    out = []
    for i in range(config.merchants):
        r = rng_of(config.seed, "merchant", i)
        out.append({"merchant": i, "rate": r.uniform(*config.hourly_rate), "decline": r.uniform(*config.decline_rate), "median": int(r.integers(*config.amount_median)), "sigma": r.uniform(*config.amount_sigma)})
    return out


def volume(config: StreamConfig, hour: np.ndarray) -> np.ndarray:
    """Rate multiplier of each hour of the stream: a bell around the peak, more on Saturdays and Sundays."""
    low, high, centre = config.diurnal
    clock = pd.to_datetime(START_MS + LOCAL_OFFSET_MS + hour * HOUR_MS, unit="ms")
    away = np.abs(clock.hour + clock.minute / 60 - centre)
    away = np.minimum(away, 24 - away)  # hours from the peak, around the clock
    bell = low * (high / low) ** np.exp(-((away / BELL_HOURS) ** 2))
    return bell * np.where(clock.dayofweek >= 5, config.weekend, 1.0)


def amounts(r: np.random.Generator, median: float, sigma: float, bounds: tuple[int, int], n: int) -> np.ndarray:
    return np.clip(r.lognormal(math.log(median), sigma, n), *bounds).astype(np.int64)


def _frame(ts, merchant, bins, cards, ips, devices, paise, declined, label, scenario) -> pd.DataFrame:
    names = ["merchant_id", "bin", "card_ref", "ip", "device_id"]
    values = [[f"mer_{m:03d}" for m in merchant], bins, cards, ips, devices]
    out = pd.DataFrame({"ts": ts, "txn_id": "", **dict(zip(names, values)), "amount_paise": paise, "status": np.where(declined, "declined", "approved"), "label": np.int32(label), "scenario_id": scenario})
    return out[[f.name for f in EVENT_SCHEMA.fields]]


def benign(spark: SparkSession, config: StreamConfig) -> DataFrame:
    ship_package(spark)
    table = pd.DataFrame(merchant_table(config))
    days = spark.range(config.total_days).select(F.col("id").alias("day"))
    work = spark.createDataFrame(table).join(F.broadcast(days)).repartition("merchant", "day")  # a row per merchant and day

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = {n: zipf(getattr(config, n), config.bin_exponent if n == "bins" else config.reuse_exponent) for n in ("cards", "ips", "devices", "bins")}
        for batch in batches:
            for m in batch.itertuples():
                r = rng_of(config.seed, "benign", m.merchant, m.day)
                hours = np.arange(24) + m.day * 24
                counts = r.poisson(m.rate * volume(config, hours))
                n = int(counts.sum())
                ts = START_MS + np.repeat(hours, counts) * HOUR_MS + r.integers(0, HOUR_MS, n)
                pick = {k: r.choice(len(w), n, p=w) for k, w in weights.items()}
                yield _frame(
                    ts, np.full(n, m.merchant), bin_name(pick["bins"], config.seed), [f"card_{i:010d}" for i in pick["cards"]], ip_name(pick["ips"]), [f"dev_{i:010d}" for i in pick["devices"]],
                    amounts(r, m.median, m.sigma, config.amount_bounds, n), r.random(n) < m.decline, 0, "benign",
                )

    return work.mapInPandas(draw, EVENT_SCHEMA)


def schedule(config: StreamConfig) -> list[dict]:
    """Episode specs: on either side of the split, the time that a kind's episodes leave is dealt out as pauses.

    Pauses are gamma-distributed shares, so episodes of a kind neither overlap nor keep time, and
    none crosses the side's end.
    """
    tables = []
    sides = {"train": (0, config.train_days), "test": (config.train_days, config.total_days)}
    for (kind, ranges), (side, (begin, end)) in itertools.product(TEMPLATES.items(), sides.items()):
        minutes, events, cards, ips, devices, declines, paise, span = ranges
        count = max(1, round((end - begin) * config.episodes_per_day))
        r = rng_of(config.seed, "schedule", kind, side)
        lasting, sizes = r.uniform(*minutes, count), r.integers(*events, count, endpoint=True)
        pauses = r.gamma(PAUSE_SHAPE, size=count + 1)
        free = max((end - begin) * DAY_MS - lasting.sum() * 60_000, 0.0)
        before = np.cumsum(pauses)[:-1] / pauses.sum() * free + (np.cumsum(lasting) - lasting) * 60_000
        drawn = {name: np.maximum(1, np.rint(sizes * r.uniform(*bounds, count))).astype(int) for name, bounds in (("cards", cards), ("ips", ips), ("devices", devices))}
        tables.append(pd.DataFrame({
            "scenario_id": kind, "side": side, "number": np.arange(count), "start_ms": START_MS + begin * DAY_MS + before.astype(np.int64), "minutes": lasting, "events": sizes, **drawn,
            "decline": r.uniform(*declines, count), "low": paise[0], "high": paise[1], "merchant": r.integers(config.merchants, size=count), "span": r.integers(*span, count, endpoint=True),
        }))
    return pd.concat(tables).sort_values(["start_ms", "scenario_id"]).to_dict("records")


def windows(specs: list[dict]) -> list[tuple[str, int, int]]:
    return [(s["scenario_id"], s["start_ms"], s["start_ms"] + math.ceil(s["minutes"] * 60_000)) for s in specs]


def episodes(spark: SparkSession, config: StreamConfig, specs: list[dict] | None = None) -> DataFrame:
    ship_package(spark)
    table = merchant_table(config)
    work = spark.createDataFrame(pd.DataFrame(schedule(config) if specs is None else specs)).repartition("scenario_id", "side", "number")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        popular, weights = zipf(config.cards, config.reuse_exponent), zipf(config.bins, config.bin_exponent)
        for batch in batches:
            for s in batch.itertuples():
                r = rng_of(config.seed, "episode", s.scenario_id, s.side, s.number)
                n, label = s.events, int(s.scenario_id in ATTACKS)
                key = zlib.crc32(f"{s.scenario_id}{s.side}{s.number}".encode())
                fresh = config.cards + key % 900_000 * 2_000
                cards = np.arange(fresh, fresh + s.cards)
                one_bin = s.scenario_id != "flash_sale"
                if s.scenario_id == "flash_sale":
                    known = r.random(s.cards) >= config.newcomers
                    cards = np.where(known, r.choice(config.cards, s.cards, p=popular), cards)
                elif not label:  # an outage's customers are known ones
                    cards = r.choice(config.cards, min(s.cards, config.cards), replace=False, p=popular)
                bins = np.full(n, r.choice(config.bins, p=weights)) if one_bin else r.choice(config.bins, n, p=weights)
                merchant = (s.merchant + r.integers(0, max(1, min(s.span, config.merchants)), n)) % config.merchants
                if s.scenario_id in ("flash_sale", "issuer_outage"):
                    medians, sigmas = (np.array([table[m][c] for m in merchant]) for c in ("median", "sigma"))
                    scale = 0.6 if s.scenario_id == "flash_sale" else 1.0  # sale prices
                    paise = np.clip(np.exp(np.log(medians * scale) + sigmas * r.standard_normal(n)), s.low, s.high).astype(np.int64)
                else:
                    paise = r.integers(s.low, s.high + 1, n)
                ts = s.start_ms + np.sort(r.integers(0, max(1, int(s.minutes * 60_000)), n))
                base = config.ips + key % 100_000
                yield _frame(
                    ts, merchant, bin_name(bins, config.seed), [f"card_{cards[i]:010d}" for i in r.integers(0, len(cards), n)], ip_name(base + r.integers(0, s.ips, n)),
                    [f"dev_{config.devices + key % 900_000 * 2_000 + i:010d}" for i in r.integers(0, s.devices, n)], paise, r.random(n) < s.decline, label, s.scenario_id,
                )

    return work.mapInPandas(draw, EVENT_SCHEMA)


def stream(spark: SparkSession, config: StreamConfig = StreamConfig()) -> DataFrame:
    """Benign traffic and episodes in one order, with ids and ``seq``."""
    return with_txn_ids(benign(spark, config).unionByName(episodes(spark, config)))


def boundary_ms(config: StreamConfig) -> int:
    return START_MS + config.train_days * DAY_MS


def seeds(config: StreamConfig, n: int) -> list[StreamConfig]:
    """The same stream under other seeds."""
    return [replace(config, seed=config.seed + k) for k in range(n)]


def parameters(config: StreamConfig) -> dict:
    return asdict(config)
