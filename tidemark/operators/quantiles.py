"""Exact quantiles of columns of any size, by narrowing a bracket with approximate ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the exact aggregate may hold at once; above, brackets narrow first.
SMALL = 200_000
ACCURACY = 5_000


def exact_quantile(rows: DataFrame, column: str, share: float, small: int = SMALL) -> float | None:
    """The quantile with linear interpolation, nulls left out; null if there is no value.

    Spark's exact percentile keeps all distinct values in one task.  Here an approximate
    percentile, whose rank error is bounded, brackets the wanted ranks; the values outside the
    bracket are only counted.  A pass keeps about 4 / ACCURACY of the rows, so even 10 ** 12 values
    take three, and the last few are ranked exactly.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n = values.count()
    if not n:
        return None
    place = share * (n - 1)
    first, last = math.floor(place), math.ceil(place)
    below, held = 0, n
    while held > small:
        margin = 2.0 / ACCURACY
        ends = [max(0.0, (first - below) / held - margin), min(1.0, (last - below + 1) / held + margin)]
        low, high = values.agg(F.percentile_approx("v", ends, ACCURACY)).first()[0]
        low = None if ends[0] == 0.0 else low
        high = None if ends[1] == 1.0 else high
        under = F.col("v") < low if low is not None else F.lit(False)
        over = F.col("v") > high if high is not None else F.lit(False)
        counts = values.agg(F.count_if(under).alias("u"), F.count_if(~under & ~over).alias("i")).first()
        if low is not None and low == high and below + counts.u <= first and last < below + counts.u + counts.i:
            return low  # one value fills the bracket
        if counts.i == held:
            # no narrower bracket: few distinct values, which the aggregate holds by count
            return values.agg(F.percentile("v", F.lit((place - below) / max(held - 1, 1)))).first()[0]
        values, below, held = values.filter(~under & ~over), below + counts.u, counts.i
    # at most ``small`` values
    ordered = sorted(r[0] for r in values.collect())
    return _between(ordered[first - below], ordered[last - below], place - first)


def _between(a: float, b: float, share: float) -> float:
    return a + (b - a) * share
