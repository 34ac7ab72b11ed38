"""Corpus pipeline: toxic documents go, repeated lines go, near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``.

Defined results: a null or empty text is neither toxic nor changed, counts as one empty line and as
a text without shingles (all such are one group), and weighs nothing in the mix; repeated rows are
near copies; a very long text is taken whole; an empty table gives none; extra columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, simhash, toxicity
from tidemark.llm.rows import ROW, spread, unpacked
from tidemark.session import written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op3's model predicts toxic go; the others stay as they are."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated over documents go; a text none of whose lines go is not touched."""
    found = lines.kept_lines(docs)
    changed, row = F.col("n_dropped") > 0, F.col(ROW)
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(row["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return found.select(*unpacked(found, docs.columns, **new))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the token ids of each document of the mix."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Learned scores and random rounding are not SQL's; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
