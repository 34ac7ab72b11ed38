"""SimHash near-dedup with vantage-point trees.

*Fingerprints.*  64 bits over 3-word shingles (repeats count); each shingle is hashed by XXH64.

*Shards.*  Fingerprints are first made distinct, so a group of exact copies is one of them.  Two that
differ in at most 3 bits differ in at most 1 bit in one of their halves of 32 bits.  For each half a
vantage-point tree, fitted on a bounded sample, parts the half-space by Hamming distance: its leaves
are shards of some ``SHARD`` fingerprints, at most ``SHARDS``.  A fingerprint lives in the shard on its side of every
boundary, and is a query in each other shard that a ball of 1 bit around it reaches by the
triangle bounds.  (In the full space, distances of unrelated fingerprints crowd around 32 +- 4 and
a ball of 3 bits crosses about 60 % of the boundaries; in a half it is 28 %, so ten levels make 12
copies rather than 110.)  A shard over ``hot`` rows is split by equality in one of four blocks of 16
bits, which any linked pair has.

*Trees.*  In a shard, a vantage-point tree over those that live there, in all 64 bits: points are
split at the median distance from a vantage point; a query goes down each side that the triangle
inequality leaves possible within the radius; leaves are compared outright.  All queries of a shard
go down together.  What comes out is a spanning forest of the shard's links (an edge from each point to
the least of its component), not its pairs, so a dense group of n near copies makes n edges.

*Groups.*  ``components`` joins the forests.

Defined results: a null or empty text (or blanks only) has fingerprint 0 and is linked like any
other; null doc_ids are rows of their own and never name a component unless all its ids are
null; repeated rows share fingerprint and component; of a very long text, shingles are counted in
chunks; an empty table gives none; extra columns, whatever their names, are carried by
``near_dedup`` and otherwise not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.rows import ROW, packed, unpacked
from tidemark.session import ship_package, written

RADIUS, HALF_RADIUS, BLOCKS, WIDTH = 3, 1, 4, 16
SHINGLE, SEED = 3, 42
LEAF, HOT = 64, 100_000
#: Fingerprints a shard aims for, the most shards of a half, and those that the trees are fitted on.
SHARD, SHARDS, SAMPLE = 512, 1024, 16_384
#: Shingles whose bits are counted at once (64 bytes each).
CHUNK = 1 << 16


# -- fingerprints -----------------------------------------------------------------------------
def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = (text or "").encode("utf-8").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return [digest(b" ".join(words), seed)] if words else []
    return [digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(size)))]


def _majority(hashes: list[int], lengths: list[int]) -> np.ndarray:
    """A fingerprint for each run of ``lengths`` hashes (length 0: fingerprint 0)."""
    out = np.zeros(len(lengths), np.uint64)
    count = np.asarray(lengths, np.int64)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    raw = np.array(hashes, dtype=np.uint64)
    starts = np.cumsum(count[full]) - count[full]
    sums = np.zeros((len(full), 64), np.int64)
    for low in range(0, len(raw), CHUNK):
        bits = np.unpackbits(raw[low : low + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = int(np.searchsorted(starts, low, side="right")) - 1
        last = int(np.searchsorted(starts, low + len(bits), side="left"))
        cuts = np.maximum(starts[first:last] - low, 0)
        sums[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    ones = (2 * sums > count[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the 64 bits as a signed long."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[int] = []
            lengths, done = [], []
            for value in batch.column(2):
                found = shingle_hashes(value.as_py(), size)
                hashes += found
                lengths.append(len(found))
                if len(hashes) >= 4 * CHUNK:
                    done.append(_majority(hashes, lengths))
                    hashes, lengths = [], []
            done.append(_majority(hashes, lengths))
            fp = np.concatenate(done).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("t"))
    return picked.mapInArrow(run, "doc_id long, text_hash long, fp long")


# -- vantage-point trees ----------------------------------------------------------------------
def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree over an array of uint64 under Hamming distance."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf, self.splits = points, leaf, 0
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        vantage = self.points[members[len(members) // 2]]
        d = _distance(self.points[members], vantage)
        middle = int(np.median(d))
        near = d <= middle
        if near.all():
            middle -= 1
            near = d <= middle
        if not near.any():  # all are at one distance from the vantage point
            return members
        self.splits += 1
        return vantage, middle, self._build(members[near]), self._build(members[~near])

    def pairs(self, radius: int, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (query, point) within ``radius``; without ``queries`` the points are, and i < j."""
        own = queries is None
        asked = self.points if own else queries
        stack = [(self.root, np.arange(len(asked)))]
        while stack:
            node, some = stack.pop()
            if isinstance(node, tuple):
                vantage, middle, near, far = node
                d = _distance(asked[some], vantage).astype(np.int16)
                stack.append((near, some[d - radius <= middle]))
                stack.append((far, some[d + radius > middle]))
                continue
            step = max(1, (1 << 20) // max(1, len(node)))
            for low in range(0, len(some), step):
                at = some[low : low + step]
                i, j = np.nonzero(_distance(asked[at][:, None], self.points[node][None, :]) <= radius)
                i, j = at[i], node[j]
                yield (i[i < j], j[i < j]) if own else (i, j)


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union by least label, in place: afterwards i and j of each pair share theirs."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(home: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, least point of its component) of one shard's links: at home, and to visitors."""
    points = np.sort(home.astype(np.uint64))
    tree = Tree(points, leaf)
    label = np.arange(len(points) + len(visitors))
    for i, j in tree.pairs(radius):
        merge_labels(label, i, j)
    if len(visitors):
        for i, j in tree.pairs(radius, visitors):
            merge_labels(label, i + len(points), j)
    every = np.concatenate([points, visitors])
    moved = np.flatnonzero(label != np.arange(len(every)))
    return every[moved], every[label[moved]]


def _tree_join(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fp, home = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)

        def out(shard, fp, home):
            cuts = np.flatnonzero((shard[1:] != shard[:-1]).any(axis=1)) + 1
            u, v = zip(*(forest(f[h], f[~h], radius) for f, h in zip(np.split(fp, cuts), np.split(home, cuts))))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            shard, fp, home = np.concatenate([shard, np.stack(columns[:2], axis=1)]), np.concatenate([fp, columns[2].view(np.uint64)]), np.concatenate([home, columns[3]])
            if not len(fp):
                continue
            # the last shard may go on in the next batch
            differ = np.flatnonzero((shard != shard[-1]).any(axis=1))
            end = int(differ[-1]) + 1 if len(differ) else 0
            if end:
                yield out(shard[:end], fp[:end], home[:end])
                shard, fp, home = shard[end:], fp[end:], home[end:]
        if len(fp):
            yield out(shard, fp, home)

    return run


# -- shards -----------------------------------------------------------------------------------
def half(fp: np.ndarray, which: int) -> np.ndarray:
    return fp >> np.uint64(32) if which else fp & np.uint64(0xFFFFFFFF)


def dealer(sample: np.ndarray, shards: int):
    """A vantage-point tree over one half of the sample: (vantage, middle, near, far) or a shard's number."""
    number = iter(range(1 << 30))

    def build(points: np.ndarray, leaves: int):
        if leaves < 2 or len(points) < 2:
            return next(number)
        d = _distance(points, points[len(points) // 2])
        middle = int(np.median(d))
        if (d <= middle).all():
            middle -= 1
        near = d <= middle
        if not near.any():
            return next(number)
        return points[len(points) // 2], middle, build(points[near], leaves // 2), build(points[~near], leaves - leaves // 2)

    return build(np.sort(sample), shards)


def dealt(tree, points: np.ndarray, radius: int = HALF_RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point's place, shard, lives there) of every shard that a ball around a point reaches."""
    places, shards, homes = [], [], []
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not isinstance(node, tuple):
            places.append(at)
            shards.append(np.full(len(at), node, np.int64))
            homes.append(home)
            continue
        vantage, middle, near, far = node
        d = _distance(points[at], vantage).astype(np.int16)
        for child, inside, reached in ((near, d <= middle, d - radius <= middle), (far, d > middle, d + radius > middle)):
            stack.append((child, at[reached], (home & inside)[reached]))
    return np.concatenate(places), np.concatenate(shards), np.concatenate(homes)


def _deal(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for which, tree in enumerate(held.value):
                place, shard, home = dealt(tree, half(fp, which))
                yield pa.RecordBatch.from_arrays([pa.array(shard * 2 + which), pa.array(fp[place].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    return run


def _block(bits: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(bits, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def shards(distinct: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(shard, sub, fp, home): each fingerprint in the shards where its partners may be."""
    spark = distinct.sparkSession
    ship_package(spark)
    count = distinct.count()
    # by a threshold on an even hash, so that no partition sends more than its share
    sample = distinct.filter(F.xxhash64("fp") <= F.lit(min(1.0, SAMPLE / max(count, 1)) * 2.0**64 - 2.0**63)).orderBy("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    aim = min(SHARDS, -(-count // shard))
    held = spark.sparkContext.broadcast([dealer(half(sample, which), aim) for which in (0, 1)])  # bounded: SHARDS nodes
    routed = written(distinct.mapInArrow(_deal(held), "shard long, fp long, home boolean"), "simhash-shards")
    large = routed.groupBy("shard").count().filter(F.col("count") > hot).select("shard", F.lit(True).alias("large"))
    fp = F.col("fp")
    subs = F.when(F.col("large"), F.array(*[_block(fp, k, WIDTH) * BLOCKS + k for k in range(BLOCKS)])).otherwise(F.array(F.lit(-1).cast("long")))
    return routed.join(F.broadcast(large), "shard", "left").select("shard", F.explode(subs).alias("sub"), "fp", "home")


def link(fps: DataFrame, radius: int = RADIUS, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(fp, component) of the distinct fingerprints that have a partner."""
    if radius > 2 * HALF_RADIUS + 1:
        raise ValueError("a radius of 4 bits and more needs a larger radius in the halves")
    distinct = written(fps.select("fp").distinct(), "simhash-distinct")
    sharded = shards(distinct, hot, shard).repartition("shard", "sub").sortWithinPartitions("shard", "sub")
    edges = sharded.mapInArrow(_tree_join(radius), "u long, v long")
    return components(edges, "simhash").select(F.col("node").alias("fp"), "component")


def groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of each row of ``docs``."""
    fps = written(fingerprints(docs), "simhash-fp")
    of_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = written(link(of_fp, hot=hot), "simhash-links")
    named = of_fp.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(named.drop("least").join(ids, "component"), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of op7."""
    return groups(docs.select("doc_id", "text")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one whose id names it (of ties, one)."""
    rows = groups(docs)
    first = Window.partitionBy("component").orderBy("fp", "text_hash")
    named = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    carried = packed(docs, _key=docs["doc_id"].cast("long"), _text=F.xxhash64(docs["text"]))
    kept = carried.join(keep, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    # by 128 bits of the whole row, so that a rerun takes the same one; rows that tie in this are equal
    tie = Window.partitionBy("_key", "_text").orderBy(F.xxhash64(ROW), F.xxhash64(F.lit("row"), ROW))
    one = kept.withColumn("_n", F.row_number().over(tie)).filter("_n = 1")
    return one.select(*unpacked(one, docs.columns))
