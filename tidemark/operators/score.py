"""The score: six additive terms, each a deviation from the entity's own history, and its flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import TERMS, DetectorConfig, features_only
from tidemark.operators import spans, stretches
from tidemark.session import written

#: Events of a stretch of time that the unkeyed baseline is carried through by one task.
STRETCH_ROWS = 1_000_000


def z_value(count: Column, samples: Column, centre: Column, spread: Column, config: DetectorConfig) -> Column:
    known = (samples >= config.min_samples) & (spread > 1e-9)
    return F.when(known, (count - centre) / spread).otherwise(0.0)


def _above(value: Column) -> Column:
    return F.greatest(F.lit(0.0), value)


def term_columns(config: DetectorConfig) -> dict[str, Column]:
    """The terms over the columns of the folds; switches are settled while the plan is built."""
    n = F.col("bin_events")
    if config.use_ewma:
        bin_z = z_value(n, F.col("bin_samples"), F.col("bin_ewma"), F.col("bin_spread"), config)
        ip_z = z_value(F.col("ip_events"), F.col("ip_samples"), F.col("ip_ewma"), F.col("ip_spread"), config) if config.use_per_ip else None
        warm = F.col("bin_samples") >= config.min_samples
    else:
        everywhere = (F.col("all_samples"), F.col("all_mean"), F.col("all_spread"))
        bin_z = z_value(n, *everywhere, config)
        ip_z = z_value(F.col("ip_events"), *everywhere, config) if config.use_per_ip else None
        warm = F.lit(True)
    known = F.col("bin_samples") >= config.min_samples
    base_ratio = F.when(known, F.col("bin_base_ratio")).otherwise(0.0)
    base_amount = F.when(known, F.col("bin_base_amount")).otherwise(0.0)
    mean = F.col("bin_amount") / n
    drop = F.when(warm & (base_amount > 0) & (mean > 0), _above(F.log(base_amount / F.when(mean > 0, mean))))
    cards, weight = (n, F.col("bin_cards")), config.w_repetition
    if config.long_window_ms:
        cards, weight = (F.col("long_events"), F.col("long_cards")), config.w_long_repetition
    retry = _above(1.0 / F.greatest(cards[1] / cards[0], F.lit(1e-9)) - 1.0)
    return {
        "velocity_bin": config.w_velocity_bin * _above(bin_z),
        "decline_bin": config.w_decline_bin * F.when(warm, _above(F.col("bin_declines") / n - base_ratio)).otherwise(0.0) * 10.0,
        "amount": config.w_amount * F.coalesce(drop, F.lit(0.0)),
        "velocity_ip": config.w_velocity_ip * (_above(ip_z) if ip_z is not None else F.lit(0.0)),
        "repetition": -weight * retry + 0.0,
        "merchant_span": -config.w_merchant_span * _above(F.col("bin_merchants").cast("double") - 1.0) + 0.0,
    }


def with_global_baseline(folded: DataFrame, config: DetectorConfig, stretch: int = STRETCH_ROWS) -> DataFrame:
    """The unkeyed baseline as it was before each event: the stream is cut into stretches of time, whose gates are composed."""
    return stretches.with_unkeyed_baseline(written(folded, "global-rows"), "bin_events", config, stretch)[0]


def fold(events: DataFrame, config: DetectorConfig, hot: int = stretches.HOT) -> DataFrame:
    """Windows and baselines of all that the score needs; two exchanges, no join.

    Keys of over ``hot`` events, which only a stream of over as many can have, are folded in stretches of time; all others are as
    before.
    """
    rows = events
    large = stretches.large(events, hot)

    def axis_fold(rows: DataFrame, axis: str, detail: bool) -> DataFrame:
        plan = stretches.prepared(events, axis, config, detail, hot) if large else None
        return stretches.split_fold(rows, axis, config, axis, detail, plan)

    if config.long_window_ms:
        rows = spans.trailing(rows, ["bin"], config.long_window_ms, False, "long", hot)
    if config.use_per_ip:
        rows = axis_fold(rows, "ip", detail=False)
    rows = axis_fold(rows, "bin", detail=True)
    if config.use_ewma:
        return rows
    if not stretches.large(events, STRETCH_ROWS):
        return stretches.with_unkeyed_baseline_in_one(rows, "bin_events", config)
    return with_global_baseline(rows, config)


def scored(events: DataFrame, config: DetectorConfig, keep: list[str] | None = None) -> DataFrame:
    """Each event with its terms, score and evidence; ``keep`` columns ride along unread."""
    carried = keep or []
    rows = fold(events.select(*features_only(events).columns, *[c for c in carried if c not in features_only(events).columns]), config)
    terms = term_columns(config)
    total = sum_in_order([F.col(t) for t in TERMS])
    known = F.col("bin_samples") >= config.min_samples
    n = F.col("bin_events")
    with_terms = rows.withColumns(terms)
    return with_terms.select(
        "seq", "ts", "txn_id", "merchant_id", "bin", "card_ref", "ip", "device_id", "amount_paise", "status",
        *[c for c in carried if c not in features_only(events).columns],
        *TERMS,
        total.alias("score"),
        n.alias("window_events"),
        F.col("bin_declines").alias("window_declines"),
        (F.col("bin_declines") / n).alias("window_decline_ratio"),
        F.when(known, F.col("bin_base_ratio")).otherwise(0.0).alias("baseline_decline_ratio"),
        (F.col("velocity_bin") / config.w_velocity_bin if config.w_velocity_bin else F.lit(0.0)).alias("velocity_z"),
        F.col("bin_ewma" if config.use_ewma else "all_mean").alias("baseline_window_events"),
        F.col("bin_cards").alias("window_distinct_cards"),
        (F.col("bin_cards") / n).alias("cards_per_event"),
        F.col("bin_merchants").alias("window_distinct_merchants"),
        (F.col("bin_amount") / n).alias("window_amount_mean_paise"),
        F.when(known, F.col("bin_base_amount")).otherwise(0.0).alias("baseline_amount_mean_paise"),
        F.col("bin_saturated").alias("window_saturated"),
    )


def variant_scores(events: DataFrame, configs: dict[str, DetectorConfig]) -> DataFrame:
    """(seq, ts) and the score of each variant, by its name, out of one fold; variants may differ in their switches and weights alone."""
    some = next(iter(configs.values()))
    switches = {f for f in vars(some) if f.startswith("w_")} | {"use_ewma", "use_per_ip"}
    if any(getattr(c, f) != getattr(some, f) for c in configs.values() for f in set(vars(some)) - switches):
        raise ValueError("variants of one fold have the same windows and baselines")
    widest = some.with_(use_ewma=all(c.use_ewma for c in configs.values()), use_per_ip=any(c.use_per_ip for c in configs.values()))
    narrow = events.select("seq", "ts", "bin", "ip", "merchant_id", "card_ref", "amount_paise", "status")
    rows = fold(narrow, widest)
    scores = [sum_in_order([term_columns(c)[t] for t in TERMS]).alias(name) for name, c in configs.items()]
    return rows.select("seq", "ts", *scores)


def sum_in_order(columns: list[Column]) -> Column:
    """Left to right, one addition at a time: the order is part of the result."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def contributions() -> Column:
    """(term, value) pairs, the weightiest first; equal ones in the order of the terms."""
    pairs = F.array(*[F.struct((-F.abs(F.col(t))).alias("k"), F.lit(i).alias("i"), F.lit(t).alias("term"), F.col(t).alias("value")) for i, t in enumerate(TERMS)])
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["term"].alias("term"), p["value"].alias("value")))


def flags(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows above the threshold (not at it), with their contributions."""
    above = rows.filter(F.col("score") > threshold)
    return above.withColumn("threshold", F.lit(float(threshold))).withColumn("contributions", contributions())


def variants(config: DetectorConfig) -> dict[str, DetectorConfig]:
    """The ablations: everything, without entity baselines, without the ip axis."""
    return {"full": config, "drop_ewma": config.with_(use_ewma=False), "drop_ip": config.with_(use_per_ip=False)}
