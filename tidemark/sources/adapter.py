"""Authorization events out of the driver's generic ``events`` table.

Every column is a fixed expression of (event_id, ts, user_id, event_type, value, props), written
once here for Spark and once as SQL.  Millisecond time floors microseconds on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ``model.EVENT_SCHEMA`` plus ``seq``, the stream's own order."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    error, purchase = F.col("event_type") == "error", F.col("event_type") == "purchase"
    scenario = (
        F.when(error & (k % 4 == 0), "burst")
        .when(error & (k % 4 == 1), "rotating")
        .when(error & (k % 4 == 2), "slow_low")
        .when(error, "issuer_outage")
        .when(purchase & (k % 10 == 0), "flash_sale")
        .when(purchase & (k % 10 == 1), "outage_single_merchant")
        .otherwise("benign")
    )
    # times without a zone are UTC, whatever the session's zone is
    instant = F.col("ts")
    if dict(raw.dtypes)["ts"] == "timestamp_ntz":
        instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    return raw.select(
        F.floor(F.unix_micros(instant.cast("timestamp")) / F.lit(1000).cast("long")).cast("long").alias("ts"),
        F.concat(F.lit("txn_"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("txn_id"),
        F.concat(F.lit("mer_"), (k % 5).cast("string")).alias("merchant_id"),
        F.concat(F.lit("0"), F.lpad((F.col("user_id") % 20).cast("string"), 5, "0")).alias("bin"),
        F.concat(F.lit("card_"), F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("card_ref"),
        F.concat(F.lit("192.0.2."), k.cast("string")).alias("ip"),
        F.concat(F.lit("dev_"), (k % 50).cast("string")).alias("device_id"),
        F.round(F.col("value") * 100).cast("long").alias("amount_paise"),
        F.when(error, "declined").otherwise("approved").alias("status"),
        F.when(error & (k % 4 < 3), 1).otherwise(0).cast("int").alias("label"),
        scenario.alias("scenario_id"),
        F.col("event_id").cast("long").alias("seq"),
    )


AUTH_SQL = """
auth AS (
  SELECT epoch_us(ts) // 1000 AS ts,
         'txn_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS txn_id,
         'mer_' || (k % 5) AS merchant_id,
         '0' || lpad(CAST(user_id % 20 AS VARCHAR), 5, '0') AS bin,
         'card_' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS card_ref,
         '192.0.2.' || k AS ip,
         'dev_' || (k % 50) AS device_id,
         CAST(round(value * 100) AS BIGINT) AS amount_paise,
         CASE WHEN event_type = 'error' THEN 'declined' ELSE 'approved' END AS status,
         CAST(CASE WHEN event_type = 'error' AND k % 4 < 3 THEN 1 ELSE 0 END AS INTEGER) AS label,
         CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'burst'
              WHEN event_type = 'error' AND k % 4 = 1 THEN 'rotating'
              WHEN event_type = 'error' AND k % 4 = 2 THEN 'slow_low'
              WHEN event_type = 'error' THEN 'issuer_outage'
              WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'flash_sale'
              WHEN event_type = 'purchase' AND k % 10 = 1 THEN 'outage_single_merchant'
              ELSE 'benign' END AS scenario_id,
         CAST(event_id AS BIGINT) AS seq
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""
