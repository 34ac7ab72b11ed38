"""Files in and out: event streams, parameters, manifests, cassettes, audit trails, digests."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import ALL_COLUMNS, EVENT_SCHEMA, FEATURE_COLUMNS, CostModel, TriageConfig, require_valid


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events from (gzipped) JSON lines; a malformed line or a broken contract fails the query."""
    raw = spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").json(path)
    return require_valid(raw)


def read_tsv(spark: SparkSession, path: str, labels: bool = False) -> DataFrame:
    """Events from tab-separated values in column order, typed and checked like any other."""
    schema = T.StructType([f for f in EVENT_SCHEMA.fields if labels or f.name in FEATURE_COLUMNS])
    raw = spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").option("comment", "#").csv(path)
    return require_valid(raw, labels)


def write_stream(events: DataFrame, path: str, files: int | None = None) -> dict:
    """JSON lines in stream order, gzipped; ``files`` ranges of it, or as many as there are.

    Returns the number of rows, their digest, and the digests of the files in order, which are the
    same bytes whenever the same rows are written in as many files.
    """
    rows = events.select(*ALL_COLUMNS)
    order = [c for c in ("ts", "txn_id") if c in rows.columns]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "gzip").json(path)
    found = content_digest(rows).first()
    written_files = file_digests(rows.sparkSession, path).orderBy("path").collect()
    return {"n_rows": found["n_rows"], "digest": found["digest"], "files": [r["sha256"] for r in written_files]}


def write_tsv(events: DataFrame, path: str) -> None:
    events.select(*FEATURE_COLUMNS).write.mode("overwrite").option("sep", "\t").csv(path)


def content_digest(rows: DataFrame) -> DataFrame:
    """(n_rows, digest): the same for the same rows in any order and partitioning."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def with_txn_ids(events: DataFrame) -> DataFrame:
    """Ids by rank in the total order (ts, scenario, merchant, card, ip)."""
    from tidemark.operators.running import with_running_totals

    order = [F.col(c).asc() for c in ("ts", "scenario_id", "merchant_id", "card_ref", "ip")]
    ranked = with_running_totals(events.drop("seq"), order, {"seq": F.lit(1).cast("long")})
    seq = F.col("seq") - 1
    return ranked.withColumn("txn_id", F.format_string("txn_%09d", seq)).withColumn("seq", seq)


# -- parameters ---------------------------------------------------------------------------------
def load_costs(text: str) -> CostModel:
    raw = tomllib.loads(text)
    ops = raw.get("operations", {})
    base = CostModel()
    return CostModel(
        auth_fee_paise=raw["auth_fee"]["paise_per_blocked_attempt"],
        chargeback_fee_paise=raw["chargeback"]["fee_paise"],
        chargeback_loss_fraction=raw["chargeback"]["loss_fraction_of_amount"],
        chargeback_rate=raw["chargeback"]["rate_on_approved_fraud"],
        contribution_margin=raw.get("blocked_good", {}).get("contribution_margin", base.contribution_margin),
        only_charge_if_approved=raw.get("blocked_good", {}).get("only_charge_if_approved", base.only_charge_if_approved),
        review_paise=raw.get("review", {}).get("paise_per_alert", base.review_paise),
        target_prevalence=raw.get("prevalence", {}).get("target", base.target_prevalence),
        alerts_per_day_budget=ops.get("alerts_per_day_budget", base.alerts_per_day_budget),
        frontier_budgets=tuple(ops.get("frontier_budgets", base.frontier_budgets)),
    )


def load_triage(text: str, mode: str = "inline") -> TriageConfig:
    ops = tomllib.loads(text)["operations"]
    return TriageConfig(mode=mode, retry_ratio=float(ops["kill_switch_retry_ratio"]), min_events=int(ops["kill_switch_min_events"]), kill_cooldown_ms=int(ops["kill_switch_cooldown_ms"]))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, through Spark, from wherever it is."""
    return spark.read.option("wholetext", "true").text(path).first()[0]


# -- manifests and reports ------------------------------------------------------------------------
def manifest(summary: DataFrame, episodes: DataFrame, parameters: Any) -> dict:
    """Parameters, split summaries and the episode schedule: small by nature, one object."""
    return {
        "parameters": asdict(parameters),
        "splits": [r.asDict() for r in summary.collect()],
        "episodes": [r.asDict() for r in episodes.orderBy("start_ms", "scenario_id").collect()],
    }


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    text = json.dumps(value, sort_keys=True, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def write_audit(audit: DataFrame, path: str) -> None:
    """The trail in its order, one JSON object per line."""
    audit.repartitionByRange("ts", "txn_id").sortWithinPartitions("ts", "txn_id", "step").write.mode("overwrite").json(path)


# -- cassettes ------------------------------------------------------------------------------------
def cassette_key(model: str, prompt: str = "prompt"):
    return F.substring(F.sha2(F.concat(F.lit(model + "\n"), F.col(prompt)), 256), 1, 32)


def read_cassettes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, model string, prompt string, response_text string").option("multiLine", "true").json(path)


def replay(prompts: DataFrame, cassettes: DataFrame, model: str, strict: bool = True) -> DataFrame:
    """``prompts`` with the recorded ``note``; a prompt without one fails the query if strict."""
    keyed = prompts.withColumn("key", cassette_key(model))
    joined = keyed.join(cassettes.select("key", F.col("response_text").alias("note")), "key", "left")
    miss = F.raise_error(F.concat(F.lit("no cassette "), F.col("key"))).cast("string") if strict else F.lit(None).cast("string")
    return joined.withColumn("note", F.coalesce("note", miss))


# -- synthetic churn ------------------------------------------------------------------------------
#: The start, the steps, the cycles and the name formats of the churning stream.
def churn(spark: SparkSession, n: int, start_ms: int = 1_700_000_000_000) -> DataFrame:
    """A stream in which every event has a new card and device and addresses come round again."""
    i = F.col("id")
    k = i % 131_072
    ip = F.concat(F.lit("198."), (18 + F.floor(k / 65_536)).cast("string"), F.lit("."), (F.floor(k / 256) % 256).cast("string"), F.lit("."), (k % 256).cast("string"))
    return spark.range(n).select(
        (F.lit(start_ms) + i * 250).cast("long").alias("ts"), F.format_string("txn_%09d", i).alias("txn_id"), F.format_string("mer_%03d", i % 10).alias("merchant_id"), F.format_string("0%05d", i % 200).alias("bin"),
        F.format_string("card_%010d", i).alias("card_ref"), ip.alias("ip"), F.format_string("dev_%010d", i).alias("device_id"), (F.lit(10_000) + (i * 7919) % 90_000).cast("long").alias("amount_paise"),
        F.when(i % 10 == 0, "declined").otherwise("approved").alias("status"), F.lit(0).alias("label"), F.lit("benign").alias("scenario_id"), i.alias("seq"),
    )


def by_stream_order(events: DataFrame, limit: int) -> DataFrame:
    """The first events of the stream."""
    return events.orderBy("ts", "seq").limit(limit)


def suppress_repeats(flags: DataFrame) -> DataFrame:
    """Flags whose (merchant, bin) differs from the flag's just before, over the whole stream."""
    here = F.struct("merchant_id", "bin")
    day = Window.partitionBy("_stretch").orderBy("ts", "seq")
    cut = flags.withColumn("_stretch", F.floor(F.col("ts") / 86_400_000))
    # within a stretch by lag; the last key of the stretch before is brought over for its first row
    ends = cut.groupBy("_stretch").agg(F.max_by(here, F.struct("ts", "seq")).alias("_last"))
    carried = ends.withColumn("_carry", F.lag("_last").over(Window.orderBy("_stretch"))).select("_stretch", "_carry")
    joined = cut.join(carried, "_stretch").withColumn("_before", F.coalesce(F.lag(here).over(day), F.col("_carry")))
    return joined.filter(~F.col("_before").eqNullSafe(here)).drop("_stretch", "_carry", "_before")
