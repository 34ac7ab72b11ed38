"""Mixing sources to target weights by pivotal dependent rounding.

Targets come from water filling over the sources: each takes its weight's share of the total,
none more than ``cap`` times its own size.  All documents of a source then have the same number
of copies to be taken, a whole part and a fraction.  The fractions are rounded by the pivotal
method: of two fractional documents one gives mass to the other, in a random direction whose
odds keep both expectations, until one of them is integral.  Mass is words (size times copies),
so a step leaves the source's expected words as they were, and one document at most stays
fractional in a group.  Groups are buckets of a source of about ``group`` documents each; what
each leaves goes up a reduction tree of ``fan`` branches, and only a source's very last
document is rounded outright, the words of which go to others it meets: documents that fit, then pairs that change
places, so that a large one costs its source no more than their sizes leave open.  A hot source has more buckets, never a larger one.

In a bucket, documents go from the largest to the smallest, and the partner of each is the pool of
all smaller ones, which share one fraction; so what is left in the end is among the smallest, unless
one is larger than all smaller ones can make up for.  A source of a few dozen documents errs by a few words where their sizes allow it;
one of a few documents can only be as near as their sums are.  Random numbers come from the seed and the group alone: reruns agree.

Rows equal in id, source and text are one entry with a number: its copies are that number of shares, of which the
whole part is taken outright and the rest is rounded as one document; each of the rows gets an
equal part of the copies, to within one.

Defined results: a null text has size 0 and takes 0 words; null is a source of its own, the
last; rows that share a doc_id are documents of their own; a very long text is a document that weighs much,
and its rounding is made up by smaller ones; an empty table gives none; extra columns, whatever
their names, are carried by ``mixed_documents``.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import ROW, packed, unpacked
from tidemark.session import ship_package, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP, SEED = (5, 2, 1), 3, 20240229
GROUP, FAN = 4096, 64


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie) of each row: ``tie`` tells texts of one id apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, source_docs, target) of (source, size, rows): one row per source.

    With sources in the order of cap over weight, those at their cap come first; the level of
    the rest is what remains of the total over what remains of the weights.
    """
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = per_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    named = named.withColumn("most", F.col("source_size") * float(cap)).withColumn("turn", F.col("most") / F.col("weight"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("turn", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = named.withColumn("level", left / weight_left)
    level = F.max(F.when(F.col("level") <= F.col("turn"), F.col("level"))).over(everything)
    return leveled.select("source", "source_size", "source_docs", F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def pivot(size: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> int:
    """Round ``x`` in place, pairing in the order given; the index left fractional, or -1."""
    carry = -1
    for j in range(len(x)):
        if not 0.0 < x[j] < 1.0:
            continue
        if carry < 0:
            carry = j
            continue
        i, ratio = carry, size[j] / size[carry]
        up, down = min(1.0 - x[i], x[j] * ratio), min(x[i], (1.0 - x[j]) * ratio)
        if rng.random() * (up + down) < down:
            i_ends, j_ends = up == 1.0 - x[i], up == x[j] * ratio
            x[i], x[j] = (1.0 if i_ends else x[i] + up), (0.0 if j_ends else x[j] - up / ratio)
        else:
            i_ends, j_ends = down == x[i], down == (1.0 - x[j]) * ratio
            x[i], x[j] = (0.0 if i_ends else x[i] - down), (1.0 if j_ends else x[j] + down / ratio)
        # what is within rounding of an end is at it
        for k in (i, j):
            if x[k] < 1e-12 or x[k] > 1.0 - 1e-12:
                x[k] = round(x[k])
        carry = next((k for k in (i, j) if 0.0 < x[k] < 1.0), -1)
    return carry


def pooled(size: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> int:
    """Round ``x``, which is one fraction for all, in place; sizes fall.  The index left, or -1.

    A document's partner is the pool of all smaller ones: it becomes integral at odds that keep
    its expectation, and the pool's common fraction takes up the words.  Once the pool is too
    small to do so, what is left of it is paired document by document.
    """
    rest, fraction = float(size.sum()), float(x[0]) if len(x) else 0.0
    for i in range(len(x)):
        rest -= size[i]
        up, down = (1.0 - fraction) * size[i], fraction * size[i]
        if up >= fraction * rest or down >= (1.0 - fraction) * rest:
            x[i:] = fraction
            left = pivot(size[i:], x[i:], rng)
            return left if left < 0 else i + left
        if rng.random() < fraction:
            x[i], fraction = 1.0, fraction - up / rest
        else:
            x[i], fraction = 0.0, fraction + down / rest
    return -1


def _mended(size: np.ndarray, x: np.ndarray, left: int, short: float, order: np.ndarray) -> tuple[float, np.ndarray]:
    """(words still short, x) with ``short`` words more, or fewer if negative, by other documents than ``left``.

    Documents that fit go to their other side from the largest down; then pairs change places, each
    time the two whose sizes differ by what is nearest to the rest, as long as the rest shrinks.
    """
    x = x.copy()
    for k in order:
        # a document helps if the gap is smaller with it than without
        if k != left and 0 < size[k] < 2 * abs(short) and x[k] == (0.0 if short > 0 else 1.0):
            x[k] = 1.0 - x[k]
            short += size[k] if short < 0 else -size[k]
    while short:
        others = order[order != left]
        into, out = others[x[others] == 0.0], others[x[others] == 1.0]
        if not len(into) or not len(out):
            break
        into = into[np.argsort(size[into], kind="stable")]
        place = np.searchsorted(size[into], size[out] + short)
        near = np.stack([np.clip(place - 1, 0, None), np.clip(place, None, len(into) - 1)])
        rest = np.abs(short - (size[into][near] - size[out]))
        side, k = np.unravel_index(int(rest.argmin()), rest.shape)
        if rest[side, k] >= abs(short):
            break
        a, b = into[near[side, k]], out[k]
        x[a], x[b] = 1.0, 0.0
        short -= size[a] - size[b]
    return short, x


def close(size: np.ndarray, x: np.ndarray, left: int, rng: np.random.Generator) -> None:
    """Round the last document, in place, to the side that others make up best for; the nearer, if both do."""
    draw = rng.permutation(len(x))
    order = draw[np.argsort(-size[draw], kind="stable")]
    found = []
    for side in (0.0, 1.0):
        start = x.copy()
        start[left] = side
        short, ends = _mended(size, start, left, (x[left] - side) * size[left], order)
        found.append((abs(short), abs(side - x[left]), side, ends))
    x[:] = min(found, key=lambda f: f[:3])[3]


def _rounder(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "tie", "x"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        name = "null" if key[0] is None else "s" + str(key[0])
        digest = hashlib.sha256(f"{seed}|{level}|{key[1]}|{name}".encode()).digest()
        x = rows["x"].to_numpy(dtype=np.float64, copy=True)
        step = pooled if level == 0 else pivot
        size, rng = rows["size"].to_numpy(dtype=np.float64), np.random.default_rng(int.from_bytes(digest[:8], "little"))
        left = step(size, x, rng)
        if last and left >= 0:
            close(size, x, left, rng)
        rows["x"] = x
        return rows

    return run


def entries(sized: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """(doc_id, source, size, tie, rows, source_size, target, copies): ``copies`` of all ``rows`` equal rows."""
    spark = sized.sparkSession
    ship_package(spark)
    sized = written(sized.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    quota = written(targets(sized, weights, cap), "mix-targets")
    most = quota.agg(F.max("source_docs")).first()[0] or 0
    share = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("rows") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = (
        sized.join(quota, sized["source"].eqNullSafe(quota["source"]))
        .drop(quota["source"])
        .withColumn("whole", F.floor(share).cast("long"))
        .withColumn("x", share - F.floor(share))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "tie"), F.ceil(F.col("source_docs") / group)).cast("long"))
        .drop("source_docs")
    )
    open_now = (F.col("x") > 0) & (F.col("x") < 1)
    settled, level, buckets = [rated.filter(~open_now)], 0, max(1, -(-most // group))
    rest = rated.filter(open_now)
    while True:
        last = buckets == 1
        done = written(rest.groupBy("source", "bucket").applyInPandas(_rounder(seed, level, last), rest.schema), f"mix-level{level}")
        settled.append(done.filter(~open_now))
        if last:
            break
        rest = done.filter(open_now).withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
        buckets, level = -(-buckets // fan), level + 1
    everything = reduce(DataFrame.unionByName, settled)
    return everything.select("doc_id", "source", "size", "tie", "rows", "source_size", "target", (F.col("whole") + F.col("x").cast("long")).alias("copies"))


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says, in two steps, so that no array is long."""
    chunks = rows.filter(F.col(times) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div 4096"))))
    left = F.least(F.lit(4096).cast("long"), F.col(times) - 4096 * F.col("_chunk"))
    return chunks.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), left))).drop("_chunk", "_nth")


def mix(sized: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """``sized`` (doc_id, source, size, tie) with source_size, target and copies (long)."""
    each, over = F.floor(F.col("copies") / F.col("rows")).cast("long"), F.pmod("copies", "rows")
    parts = F.array(F.struct(over.alias("n"), (each + 1).alias("copies")), F.struct((F.col("rows") - over).alias("n"), each.alias("copies")))
    found = entries(sized, weights, cap, seed, group, fan).withColumn("_part", F.explode(parts)).withColumn("_n", F.col("_part.n"))
    return _repeated(found, "_n").select("doc_id", "source", "size", "tie", "source_size", "target", F.col("_part.copies").alias("copies"))


def _allotted(marks: DataFrame, taken: DataFrame) -> DataFrame:
    """(_h, _g, alike, each, more): of ``alike`` rows equal in all columns, ``more`` take a copy above ``each``.

    ``marks`` has no texts: an entry's key and two hashes of the whole row.  What an entry has over
    goes to its rows in the order of the hashes; they are counted in ranges of the first one, so a
    task has no entry of many rows to itself.
    """
    key = ["_id", "_source", "_size", "_text"]
    alike = marks.groupBy(*key, "_h", "_g").agg(F.count(F.lit(1)).alias("alike"))
    same = reduce(lambda a, b: a & b, [alike[k].eqNullSafe(taken[c]) for k, c in zip(key, ("doc_id", "source", "size", "tie"))])
    found = alike.join(taken, same).select(*key, "_h", "_g", "alike", "rows", F.floor(F.col("copies") / F.col("rows")).cast("long").alias("each"), F.pmod("copies", "rows").alias("over"))
    found = written(found, "mix-alike")
    parts = F.ceil(F.col("rows") / GROUP)
    ranged = found.filter("over > 0").withColumn("_range", F.least(parts - 1, F.floor((F.col("_h") / 2.0**64 + 0.5) * parts)).cast("long"))
    running = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = ranged.groupBy(*key, "_range").agg(F.sum("alike").alias("_held")).withColumn("_start", F.coalesce(F.sum("_held").over(running), F.lit(0)))
    start = start.select(*[F.col(c).alias(f"{c}_of") for c in (*key, "_range")], "_start")
    within = Window.partitionBy(*key, "_range").orderBy("_h", "_g").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_before", F.coalesce(F.sum("alike").over(within), F.lit(0)))
    placed = inside.join(start, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*key, "_range")]))
    more = F.greatest(F.lit(0), F.least(F.col("alike"), F.col("over") - F.col("_start") - F.col("_before"))).cast("long")
    told = placed.select("_h", "_g", "alike", "each", more.alias("more"))
    return told.unionByName(found.filter("over = 0").select("_h", "_g", "alike", "each", F.lit(0).cast("long").alias("more"))).filter("each + more > 0")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (0 to ``cap`` times).

    Of rows equal in id, source and text, the first by a hash of the whole row take what is over.
    """
    words = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")
    carried = packed(docs, _id=docs["doc_id"], _source=docs["source"], _size=words, _text=F.xxhash64(docs["text"]))
    marked = carried.withColumn("_h", F.xxhash64(ROW)).withColumn("_g", F.xxhash64(F.lit("row"), ROW))
    allotted = _allotted(marked.drop(ROW), entries(sizes(docs), **options).filter("copies > 0"))
    found = marked.select(ROW, "_h", "_g").join(allotted, ["_h", "_g"])
    whole = found.filter("more = 0 or more = alike").select(ROW, (F.col("each") + (F.col("more") > 0).cast("long")).alias("_copies"))
    # of rows equal in all columns any one stands for all of them
    parted = found.filter("more > 0 and more < alike").groupBy("_h", "_g").agg(F.first(ROW).alias(ROW), F.first(F.expr("alike * each + more")).alias("_copies"))
    every = _repeated(whole.unionByName(parted.select(ROW, "_copies")), "_copies")
    return every.select(*unpacked(every, docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of op6."""
    return mix(sizes(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
