"""Rows carried as one column, so that no name of theirs meets a name an operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"


#: Partitions up to which a table is small: some 8 GB, at the default size of a split.
FEW = 64


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where it comes in few partitions (``FEW``), and in fewer than there are cores.

    A small table often is one file of one row group, which would be one task; a large one isn't
    touched, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW) else df


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """(``_row``: all columns of ``df``, and the columns given)."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(ROW), *[v.alias(k) for k, v in extra.items()])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> list[Column]:
    """The carried columns in their order, those in ``changed`` with another value."""
    return [changed[c].alias(c) if c in changed else F.col(ROW)[c].alias(c) for c in columns]
