"""Scalar expressions over identifiers, addresses, money and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of_day(ts: Column) -> Column:
    return F.pmod(F.floor(ts / 3_600_000), F.lit(24)).cast("int")


def is_synthetic_bin(value: Column) -> Column:
    """Six digits with the reserved leading zero."""
    return value.rlike(r"^0[0-9]{5}$")


def is_token(value: Column, prefix: str) -> Column:
    return value.rlike(f"^{prefix}_[0-9]+$")


def ipv4(value: Column) -> Column:
    """The address as a number; null if it isn't four numbers of a byte each."""
    parts = F.split(value, r"\.", -1)
    number = lambda k: F.get(parts, F.lit(k)).cast("long")
    good = value.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$")
    total = ((number(0) * 256 + number(1)) * 256 + number(2)) * 256 + number(3)
    fits = F.greatest(*[F.try_to_number(F.get(parts, F.lit(k)), F.lit("999")).cast("long") for k in range(4)]) < 256
    return F.when(good, F.when(fits, total))


def in_cidr(value: Column, network: str) -> Column:
    base, bits = network.split("/")
    first = 0
    for part in base.split("."):
        first = first * 256 + int(part)
    size = 1 << (32 - int(bits))
    return F.coalesce(ipv4(value).between(first, first + size - 1), F.lit(False))


#: Address blocks reserved for documentation and benchmarks.
RESERVED_NETWORKS = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "198.18.0.0/15")


def is_synthetic_ip(value: Column) -> Column:
    found = F.lit(False)
    for network in RESERVED_NETWORKS:
        found = found | in_cidr(value, network)
    return found


def decimal_text(numerator: Column, denominator: Column, places: int, commas: bool = False) -> Column:
    """A ratio of integers in fixed places, halves away from zero, by integer arithmetic."""
    scale = 10**places
    scaled = F.call_function("div", F.abs(numerator) * (2 * scale) + denominator, 2 * denominator)
    whole = F.call_function("div", scaled, F.lit(scale))
    text = F.format_number(whole, 0) if commas else whole.cast("string")
    text = F.concat(F.when(numerator < 0, "-").otherwise(""), text)
    return F.concat(text, F.lit("."), F.lpad((scaled % scale).cast("string"), places, "0")) if places else text


def rupees(paise: Column) -> Column:
    """Crore and lakh above their sizes, else plain rupees."""
    r = F.abs(paise) / 100.0
    sign = F.when(paise < 0, "-").otherwise("")
    text = F.when(r >= 1e7, F.format_string("Rs %.2fCr", r / 1e7)).when(r >= 1e5, F.format_string("Rs %.2fL", r / 1e5)).otherwise(F.concat(F.lit("Rs "), F.format_number(r, 0)))
    return F.concat(sign, text)


def percent(share: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", share * 100.0)
