"""Document fingerprints of closed syncmers, and how much of two texts stands in the same order.

*Anchors.*  Of all stretches of ``K`` bytes those are chosen whose least stretch of ``S`` bytes (by a fixed
hash, the leftmost of equal ones) lies at the stretch's start or end.  That depends on the K bytes
alone, so an edit elsewhere neither adds nor removes an anchor, and of ``K - S`` neighbouring stretches one is
chosen at least: an unchanged passage of 2 K bytes keeps its anchors wherever it stands.  About 2 in ``K - S + 1`` places are anchors.

*Fingerprint.*  The anchors in order, six characters each: how far it lies behind the one before, and 30 bits of a hash of its K
bytes.  A text without an anchor (it is short, as a rule) has one of its whole text, marked as such; the empty text has none.

*Likeness.*  The i-th anchor of a hash meets the i-th of that hash in the other text; of the pairs met, the longest chain
that ascends in both texts counts: 2 * chain / (anchors of both).  Equal fingerprints have 1, none in common 0.

*Successors.*  Every document meets the next one (by doc_id) in one pass: keys chosen from all rows are the bounds of
ranges; a row that is a bound itself is sent to the range before it too, so every range has the
successor of its last row; the first row of all is sent to the last range.  One shuffle of the texts, no
unpartitioned window; a task holds two texts.

Defined results: a null text is the empty one; a null doc_id comes before all others; rows of one doc_id are ordered by a hash of
their text, equal rows follow each other; a table of one row is followed by itself; an empty table gives none; extra
columns are ignored, whatever their names; a very long text is read in blocks.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package

#: Bytes of a stretch and of the stretches in it.  K is a multiple of 8, K - S a power of two below 64.
K, S = 40, 8
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
#: Ranges for each shuffle partition, and keys looked at for each of their bounds, about.
RANGES, KEYS = 4, 16
#: Six bits a character.
DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
#: Before the hash of a text without anchors.
WHOLE = "="
ROWS = 256

_DIGIT = np.frombuffer(DIGITS, np.uint8)
_VALUE = np.zeros(256, np.int64)
_VALUE[_DIGIT] = np.arange(64)
_SHIFTS = np.array([24, 18, 12, 6, 0], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _words(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    out = np.empty(len(raw) - 7, np.uint64)
    for r in range(min(8, len(out))):
        out[r::8] = np.frombuffer(raw, "<u8", (len(raw) - r) // 8, r)
    return out


def _block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of at least K bytes."""
    words = _words(raw)
    order = _mixed(words * np.uint64(0x9E3779B97F4A7C15))
    least, reach = order, 1
    while reach < K - S:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    # least[i] is that of places i to i + K - S - 1
    at = np.flatnonzero((order[: len(least) - 1] <= least[1:]) | (order[K - S :] < least[:-1]))
    value = np.zeros(len(at), np.uint64)
    for step in range(0, K, 8):
        value = _mixed((value ^ words[at + step]) * np.uint64(0x9E3779B97F4A7C15))
    return at, value >> np.uint64(34)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places in bytes, hashes of 30 bits) of all anchors of a text."""
    found = [(at + start, value) for start in range(0, len(raw) - K + 1, BLOCK) for at, value in [_block(raw[start : start + BLOCK + K - 1])]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([v for _, v in found])


def written_out(raw: bytes) -> str:
    """The fingerprint of a text."""
    at, value = anchors(raw)
    if not len(at):
        return WHOLE + hashlib.sha256(raw).hexdigest()[:16] if raw else ""
    # neighbours are at most K - S apart; the first may stand further on only in a text read in part
    gaps = np.diff(at, prepend=0)
    digits = np.empty((len(at), 6), np.uint8)
    digits[:, 0] = _DIGIT[np.minimum(gaps, 63)]
    digits[:, 1:] = _DIGIT[((value[:, None] >> _SHIFTS) & np.uint64(63)).astype(np.int64)]
    return digits.tobytes().decode()


def read_back(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a fingerprint; a whole-text one has none."""
    if not fingerprint or fingerprint[0] == WHOLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    digits = _VALUE[np.frombuffer(fingerprint.encode(), np.uint8).reshape(-1, 6)]
    return np.cumsum(digits[:, 0]), digits[:, 1:] @ (1 << np.array([24, 18, 12, 6, 0]))


def _turns(value: np.ndarray) -> np.ndarray:
    """Each anchor's hash together with how many of that hash stand before it."""
    order = np.argsort(value, kind="stable")
    ordered = value[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    turn = np.arange(len(value)) - np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))
    out = np.empty(len(value), np.int64)
    out[order] = (ordered << 33) + turn
    return out


def like(a: str, b: str) -> float:
    """How much two fingerprints have in common, in order (0 to 1)."""
    if a == b:
        return 1.0
    x, y = read_back(a)[1], read_back(b)[1]
    if not len(x) or not len(y):
        return 0.0
    both, here, there = np.intersect1d(_turns(x), _turns(y), assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    there = there[np.argsort(here)]
    if (np.diff(there) > 0).all():
        chain = len(there)
    else:
        tails: list[int] = []
        for place in there.tolist():
            k = bisect.bisect_left(tails, place)
            tails[k : k + 1] = [place]
        chain = len(tails)
    return 2.0 * chain / (len(x) + len(y))


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text; no shuffle."""
    ship_package(docs.sparkSession)

    @F.pandas_udf(T.StringType())
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda raw: written_out(raw or b""))

    return docs.withColumn(name, made(F.col(text).cast("string").cast("binary")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null if one is."""

    @F.pandas_udf(T.DoubleType())
    def compared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else like(x, y) for x, y in zip(left, right)], dtype="float64")

    return F.when(a.isNotNull() & b.isNotNull(), compared(a, b))


def edited(text: str, other: str) -> str:
    """``text``, the last half of its code points replaced by the first as many of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _key(doc_id: int | None, h: int) -> tuple[bool, int, int]:
    return (doc_id is not None, doc_id or 0, h)


def _bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """At most ``ranges`` keys of the table in order, the first of all among them."""
    rows = keys.count()
    share = min(1.0, ranges * KEYS / max(rows, 1))
    pair = F.struct(F.col("_id").isNotNull().alias("known"), "_id", "_h")
    drawn = F.when(F.pmod(F.xxhash64("_id", "_h", F.lit(12)), F.lit(1 << 20)) < int(share * (1 << 20)), pair)
    first, some = keys.agg(F.min(pair), F.collect_set(drawn)).first()
    if first is None:
        return []
    least = _key(first["_id"], first["_h"])
    found = sorted({least, *(_key(r["_id"], r["_h"]) for r in some)})
    return [found[0], *found[1 :: max(1, -(-(len(found) - 1) // max(1, ranges - 1)))]]


def with_successor(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(_range, _last, _id, _h, text) of ``docs`` with each range's successor as its last row, dealt and sorted by range."""
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"))
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(rows.select("_id", "_h"), ranges)

    # ids come as strings: a null among numbers would make all of them floats
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        out = []
        for doc_id, h in zip(ids, hashes.tolist()):
            key = _key(None if doc_id is None else int(doc_id), h)
            k = bisect.bisect_right(bounds, key) - 1
            out.append([k, (k - 1) % len(bounds)] if key == bounds[k] else [k])
        return pd.Series(out, dtype=object)

    at = rows.withColumn("_places", places(F.col("_id").cast("string"), F.col("_h"))).select("*", F.posexplode("_places").alias("_copy", "_range"))
    return at.select("_range", (F.col("_copy") > 0).alias("_last"), "_id", "_h", "text").repartition("_range").sortWithinPartitions("_range", "_last", F.col("_id").asc_nulls_first(), "_h")


_MADE = [("doc_id", T.LongType(), pa.int64()), ("n_chars", T.LongType(), pa.int64()), ("edited", T.StringType(), pa.string())]
_MADE += [(n, T.StringType(), pa.string()) for n in ("fingerprint", "edited_fingerprint", "next_fingerprint")]


def beside_successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint, near_edited, near_next) of each document."""
    schema = T.StructType([*(T.StructField(n, kind) for n, kind, _ in _MADE), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    kinds = [*(kind for _, _, kind in _MADE), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None  # the range; the row whose successor comes next: (doc_id, text, fingerprint)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                rows = []
                for here, last, doc_id, text in zip(*(c.to_pylist() for i, c in enumerate(whole.slice(start, ROWS).columns) if i != 3)):
                    mark = written_out(text.encode())
                    if held is not None and here == at:
                        own, before, print_ = held
                        new = edited(before, text)
                        new_mark = written_out(new.encode())
                        rows.append((own, len(before), new, print_, new_mark, mark, like(print_, new_mark), like(print_, mark)))
                    at, held = here, None if last else (doc_id, text, mark)
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds)], names=schema.names)

    return with_successor(docs, ranges).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Digest rows of op12."""
    made = beside_successors(docs.select("doc_id", "text"))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
