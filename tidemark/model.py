"""The event model: schema, column roles, parameters, and the input contract."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

APPROVED, DECLINED = "approved", "declined"
ATTACKS = ("burst", "rotating", "slow_low")
CONTROLS = ("flash_sale", "issuer_outage", "outage_single_merchant")
SCENARIOS = ("benign", *CONTROLS, *ATTACKS)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.LongType(), False),
        T.StructField("txn_id", T.StringType(), False),
        T.StructField("merchant_id", T.StringType(), False),
        T.StructField("bin", T.StringType(), False),
        T.StructField("card_ref", T.StringType(), False),
        T.StructField("ip", T.StringType(), False),
        T.StructField("device_id", T.StringType(), False),
        T.StructField("amount_paise", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("label", T.IntegerType(), False),
        T.StructField("scenario_id", T.StringType(), False),
    ]
)
ALL_COLUMNS = tuple(EVENT_SCHEMA.names)
LABEL_COLUMNS = ("label", "scenario_id")
#: What a scorer may see; labels are unreachable because they are never selected.
FEATURE_COLUMNS = tuple(c for c in ALL_COLUMNS if c not in LABEL_COLUMNS)

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
TERMS = ("velocity_bin", "decline_bin", "amount", "velocity_ip", "repetition", "merchant_span")


@dataclass(frozen=True)
class DetectorConfig:
    window_ms: int = 300_000
    ring_capacity: int = 512
    sample_interval_ms: int = 60_000
    min_samples: int = 20
    halflife_samples: float = 30.0
    w_velocity_bin: float = 1.0
    w_decline_bin: float = 2.0
    w_amount: float = 1.0
    w_velocity_ip: float = 0.5
    w_repetition: float = 1.2
    w_merchant_span: float = 1.4
    threshold: float = 3.0
    use_ewma: bool = True
    use_per_ip: bool = True
    #: Replaces the short-window repetition term by one over ``long_window_ms`` (None: off).
    long_window_ms: int | None = None
    w_long_repetition: float = 1.2

    def with_(self, **changes) -> DetectorConfig:
        return replace(self, **changes)


@dataclass(frozen=True)
class CostModel:
    auth_fee_paise: float = 150
    chargeback_fee_paise: float = 50_000
    chargeback_loss_fraction: float = 1.0
    chargeback_rate: float = 0.8
    contribution_margin: float = 0.25
    only_charge_if_approved: bool = True
    review_paise: float = 4_000
    target_prevalence: float = 0.0015
    alerts_per_day_budget: float = 10.0
    frontier_budgets: tuple[float, ...] = (2, 5, 8, 10, 12, 15, 20, 30, 50)


@dataclass(frozen=True)
class TriageConfig:
    mode: str = "inline"
    dedup_cooldown_ms: int = 900_000
    trailing_ms: int = HOUR_MS
    retry_ratio: float = 2.5
    min_events: int = 20
    kill_cooldown_ms: int = HOUR_MS
    auth_fee_paise: float = 150
    chargeback_fee_paise: float = 50_000
    chargeback_loss_fraction: float = 1.0
    chargeback_rate: float = 0.8

    def __post_init__(self):
        if self.mode not in ("inline", "alert_only"):
            raise ValueError(f"unknown mode {self.mode!r}")


def config_hash(config) -> str:
    """sha256 of the canonical JSON of a parameter set."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True, separators=(",", ":"), default=list).encode()).hexdigest()


def problem(labels: bool = True) -> Column:
    """Why a row breaks the input contract, or null; nulls break it in every column."""
    strings = ["merchant_id", "bin", "card_ref", "ip", "device_id"]
    checks = [(F.col(c).isNull(), f"{c} is null") for c in (ALL_COLUMNS if labels else FEATURE_COLUMNS)]
    checks += [(~F.col("status").isin(APPROVED, DECLINED), "unknown status")]
    checks += [(F.col(c) == "", f"{c} is empty") for c in strings]
    checks += [(F.col("amount_paise") < 0, "amount is negative")]
    found = F.lit(None).cast("string")
    for bad, name in reversed(checks):
        found = F.when(bad, F.lit(name)).otherwise(found)
    return found


def split_valid(events: DataFrame, labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with the reason)."""
    marked = events.withColumn("problem", problem(labels))
    return marked.filter("problem is null").drop("problem"), marked.filter("problem is not null")


def require_valid(events: DataFrame, labels: bool = True) -> DataFrame:
    """The same rows; running the plan fails at the first that breaks the contract."""
    why = problem(labels)
    ok = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("invalid event: "), why)).cast("string")).otherwise(F.col("status"))
    return events.withColumn("status", ok)


def features_only(events: DataFrame) -> DataFrame:
    keep = [c for c in events.columns if c in FEATURE_COLUMNS or c == "seq"]
    return events.select(*keep)
