"""The cost model over flagged rows, and prevalence reweighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import CostModel
from tidemark.operators.metrics import INFINITY, quotient, ratio


def basis(flagged: Column, model: CostModel) -> list[Column]:
    """Integer sums from which all amounts follow, so no order of addition matters."""
    fraud, clean = flagged & (F.col("label") == 1), flagged & (F.col("label") == 0)
    approved = F.col("status") == "approved"
    charged = clean & approved if model.only_charge_if_approved else clean
    zero = F.lit(0).cast("long")
    amount = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("amount_paise")).otherwise(zero)), zero)
    return [
        F.count_if(fraud).alias("n_fraud"), F.count_if(fraud & approved).alias("n_fraud_approved"), amount(fraud & approved).alias("fraud_approved_paise"),
        F.count_if(clean).alias("blocked_good_events"), F.count_if(clean & ~charged).alias("would_decline"), amount(charged).alias("charged_paise"),
    ]


def priced(model: CostModel) -> dict[str, Column]:
    fees = F.col("n_fraud") * float(model.auth_fee_paise)
    avoided = model.chargeback_rate * (F.col("n_fraud_approved") * float(model.chargeback_fee_paise) + model.chargeback_loss_fraction * F.col("fraud_approved_paise"))
    blocked = model.contribution_margin * F.col("charged_paise")
    return {"saved_auth_fees_paise": fees, "avoided_chargebacks_paise": avoided, "blocked_good_paise": blocked, "gross_paise": fees + avoided - blocked}


def break_even() -> Column:
    """The review cost per alert at which the position is nil."""
    nothing = F.when(F.col("gross_paise") > 0, F.lit(INFINITY)).otherwise(0.0)
    return F.when(F.col("alerts") == 0, nothing).otherwise(F.try_divide(F.col("gross_paise"), F.col("alerts")))


def cost_breakdown(rows: DataFrame, threshold: float, model: CostModel, alert_count: int | Column) -> DataFrame:
    """One row; the count of alerts is given, since it is not of the rows but of their runs."""
    alerts = alert_count if isinstance(alert_count, Column) else F.lit(alert_count)
    sums = rows.agg(*basis(F.col("score") > threshold, model)).withColumns(priced(model)).withColumn("alerts", alerts.cast("long"))
    return sums.withColumns({"net_paise": F.col("gross_paise") - F.col("alerts") * float(model.review_paise), "break_even_paise": break_even()})


def cost_by_scenario(rows: DataFrame, threshold: float, model: CostModel) -> DataFrame:
    flagged = rows.filter(F.col("score") > threshold)
    grouped = flagged.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("flagged"), *basis(F.lit(True), model))
    return grouped.select("scenario_id", "flagged", priced(model)["blocked_good_paise"].alias("blocked_good_paise"))


def reweighted(confusion: DataFrame, target: float, ieee: bool = False) -> DataFrame:
    """Rates if negatives were as many as ``target`` prevalence asks; positives stay.

    Both classes are needed, and a precision without flags is nought; with ``ieee`` what is undefined comes out as IEEE 754 divides.
    """
    if not 0 < target < 1:
        raise ValueError("the target prevalence is between 0 and 1")
    good, bad = F.col("fp") + F.col("tn"), F.col("tp") + F.col("fn")
    wanted = bad * ((1.0 - target) / target)
    if ieee:
        scale, share, rate = quotient(wanted, good), quotient, quotient
    else:
        one_class = F.raise_error(F.lit("reweighting needs both classes")).cast("double")
        scale, share, rate = F.when((good == 0) | (bad == 0), one_class).otherwise(wanted / good), lambda a, b: a / b, ratio
    scaled = confusion.withColumn("negative_scale", scale).withColumn("effective_fp", F.col("fp") * F.col("negative_scale"))
    return scaled.select(
        share(bad, bad + good).alias("observed_prevalence"),
        F.lit(target).alias("target_prevalence"),
        "negative_scale",
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_observed"),
        rate(F.col("tp").cast("double"), F.col("tp") + F.col("effective_fp")).alias("precision_target"),
        share(F.col("tp"), bad).alias("recall"),
        "effective_fp",
    )
