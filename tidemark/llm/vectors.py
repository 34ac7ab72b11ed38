"""Embedding near-dedup over robust-pruned flat graphs.

*Classes.*  Equal vectors are one class with a count, so groups of exact copies cost one vector.

*Regions.*  Centres are fitted on a bounded sample (``SAMPLE`` vectors).  Centres that part a linked
pair of the sample, each vector being dealt to the ``OVERLAP`` nearest, are one region, so a dense
group is one whatever its size.  Every class is dealt to its ``OVERLAP`` nearest regions; then
``AUDITED`` classes are compared with all of them, and regions that part a linked pair are made
one, until no pair is lost.  A pair that shares several regions is counted in the first of them
only.  A region with more than ``BLOCK`` vectors is searched block against block.

*Graph.*  Within a region: overlapping clusters (each vector in its two nearest), the nearest
neighbours inside each cluster, robust pruning (a neighbour is dropped if a kept one is nearer
to it than the vector is, by a factor of ``ALPHA``), then the union of the clusters' adjacency
lists, with reverse edges.

*Search.*  Where a vector links to more than one in ``MAX_DEGREE`` of the others, all are compared
outright, which is less work than following edges.  Elsewhere: greedy from the medoids, ``STEPS`` expansions, then range expansion: every vector found
within the threshold, or close to it, is expanded until none is left.  All queries of a block
step together.  Links are verified by cosine in double precision.

*Audit.*  Beside the audit across regions, every block compares a sample of its queries with brute
force, no query being counted as a link of its own; one that finds less than ``MIN_RECALL`` of the
links is searched outright.  In the end ``audited_recall`` compares the links of some ``AUDITED``
classes with brute force over all, and the share found is a column of the result.  Should it be
under ``LEAST_RECALL``, all regions are searched outright, and should that not do, all vectors of
one length are one region, whose blocks are compared with each other: that is exact, and quadratic.

Defined results: a vector that is null, empty, zero or has a null or non-finite component has no
link and is its own component; vectors of different lengths have no link; rows that share a
vec_id are vectors of their own; a null vec_id names no component unless all its ids are null;
an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.simhash import merge_labels
from tidemark.session import drop_written, ship_package, written

THRESHOLD = 0.9
SAMPLE, REGION, MAX_REGIONS, OVERLAP = 20_000, 1000, 4096, 3
BLOCK, CLUSTER = 8192, 400
CANDIDATES, DEGREE, ALPHA, MAX_DEGREE = 32, 16, 1.2, 40
STEPS, SLACK, QUERIES = 24, 0.08, 256
AUDIT, MIN_RECALL, AUDITED, LEAST_RECALL = 50, 0.95, 1000, 0.9
SEED = 17


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, node), (classes: node, least, copies, v): node is null for unusable vectors."""
    v = F.col("embedding").cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
    rows = rows.withColumns({"_one": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "_two": F.xxhash64(F.lit("class"), "v")})
    # unequal vectors whose hashes fall together (next to none) are told apart by a second hash
    both = rows.filter("_one is not null").groupBy(F.col("_one").alias("_of")).agg(F.min("_two").alias("_least"), F.max("_two").alias("_most")).filter("_least <> _most")
    told = rows.join(both.select("_of", "_least"), F.col("_one") == F.col("_of"), "left")
    rows = told.select("vec_id", "v", F.when(F.col("_least").isNull() | (F.col("_two") == F.col("_least")), F.col("_one")).otherwise(F.col("_two")).alias("node"))
    grouped = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    return rows.select("vec_id", "node"), grouped


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _about(rows: DataFrame, n: int, of: int, salt) -> DataFrame:
    """Some ``n`` of the ``of`` rows, by a threshold on an even hash: no partition sends more than its share."""
    return rows.filter(F.xxhash64("node", salt) <= F.lit(min(1.0, n / max(of, 1)) * 2.0**64 - 2.0**63))


def centres(grouped: DataFrame, region: int = REGION, seed: int = SEED, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(unit centres, region of each) by vector length, from a bounded sample; a centre per ``region`` vectors."""
    sizes = {r[0]: r[1] for r in grouped.groupBy(F.size("v")).count().collect()}
    if not sizes:
        return {}
    rows = _about(grouped.select("node", "v"), SAMPLE, sum(sizes.values()), F.lit("centres")).orderBy("node").toPandas()
    out, rng = {}, np.random.default_rng(seed)
    for dim, part in rows.groupby(rows["v"].map(len)):
        x = _unit(np.array(part["v"].tolist()))
        k = int(min(len(x), MAX_REGIONS, -(-sizes[dim] // region)))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(4):
            near = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            moved = np.bincount(near, minlength=k) > 0
            c[moved] = _unit(sums[moved] + 1e-12)
        out[dim] = c, joined_centres(x, c, threshold, overlap)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (regions, -1: none) have no region in common."""
    return ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))


def joined_centres(x: np.ndarray, c: np.ndarray, threshold: float, overlap: int) -> np.ndarray:
    """Region (least centre) of each centre: those that part a linked pair of ``x`` are one."""
    label, k = np.arange(len(c)), min(overlap, len(c))
    if k == len(c):
        return label
    small, near = x.astype(np.float32), np.zeros((len(x), k), np.int64)
    for low in range(0, len(x), 1024):
        near[low : low + 1024] = np.argsort(-(x[low : low + 1024] @ c.T), axis=1, kind="stable")[:, :k]
    for low in range(0, len(x), 512):
        table = label[near]
        hit = (small[low : low + 512] @ small[low:].T) >= threshold - 1e-3
        i, j = np.nonzero(hit & (table[low : low + 512, :1] != table[None, low:, 0]))
        for at in range(0, len(i), 1 << 18):
            u, v = i[at : at + (1 << 18)] + low, j[at : at + (1 << 18)] + low
            lost = _apart(label[near[u]], label[near[v]])
            merge_labels(label, near[u[lost], 0], near[v[lost], 0])
    return label


def _nearest(x: np.ndarray, c: np.ndarray, label: np.ndarray, overlap: int) -> np.ndarray:
    """The ``overlap`` regions with the nearest centres to each row of ``x``, nearest first."""
    order = np.argsort(label, kind="stable")
    names, starts = np.unique(label[order], return_index=True)
    best = np.maximum.reduceat(x @ c[order].T, starts, axis=1)
    return names[np.argsort(-best, axis=1, kind="stable")[:, :overlap]]


def _deal(held, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            near: list[list[int]] = [[0]] * len(vectors)
            length = np.array(list(map(len, vectors)))
            for dim in np.unique(length):
                if dim in table:
                    at = np.flatnonzero(length == dim)
                    for low in range(0, len(at), 1024):
                        some = at[low : low + 1024]
                        for k, found in zip(some, _nearest(_unit(np.array([vectors[k] for k in some])), *table[dim], overlap).tolist()):
                            near[k] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=["node", "copies", "v", "regions"])

    return run


def _table(regions: list) -> np.ndarray:
    longest = max(map(len, regions))
    return np.array([[*r, *[-1] * (longest - len(r))] for r in regions], np.int64)


def lost_pairs(dealt: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> pd.DataFrame:
    """(dim, u, v, n): pairs of regions, nearest to the ends of ``n`` links that share no region.

    Of ``audited`` classes with all: the work is linear in the number of classes.
    """
    queries = _about(dealt, audited, dealt.count(), F.lit("audit")).select("v", "regions").toPandas()
    if queries.empty:
        return pd.DataFrame(columns=["dim", "u", "v", "n"])
    by_length = {d: (_unit(np.array(part["v"].tolist())), _table(part["regions"].tolist())) for d, part in queries.groupby(queries["v"].map(len))}
    held = dealt.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        count: Counter = Counter()
        for batch in batches:
            rows, regions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            length = np.array(list(map(len, rows)))
            for d, (q, of_query) in held.value.items():
                where = np.flatnonzero(length == d)
                for low in range(0, len(where), 4096):
                    at = where[low : low + 4096]
                    table = _table([regions[k] for k in at])
                    hit = (q @ _unit(np.array([rows[k] for k in at])).T) >= threshold
                    i, j = np.nonzero(hit & (of_query[:, :1] != table[None, :, 0]))
                    for a in range(0, len(i), 1 << 18):
                        some, other = of_query[i[a : a + (1 << 18)]], table[j[a : a + (1 << 18)]]
                        lost = _apart(some, other)
                        pair, n = np.unique(np.stack([some[lost, 0], other[lost, 0]], axis=1), axis=0, return_counts=True)
                        count.update({(d, int(u), int(v)): int(m) for (u, v), m in zip(pair, n)})
        rows = [(*key, n) for key, n in count.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["dim", "u", "v", "n"])

    found = dealt.select("v", "regions").mapInArrow(run, "dim long, u long, v long, n long")
    return found.groupBy("dim", "u", "v").agg(F.sum("n").alias("n")).toPandas()


def regions(grouped: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, region: int = REGION) -> DataFrame:
    """(node, copies, v, regions: nearest first) of each class; no link of the audited is lost."""
    spark = grouped.sparkSession
    ship_package(spark)
    table = centres(grouped, region, threshold=threshold, overlap=overlap)
    schema = "node long, copies long, v array<double>, regions array<int>"
    while True:
        held = spark.sparkContext.broadcast(table)  # bounded: MAX_REGIONS vectors
        dealt = written(grouped.select("node", "copies", "v").mapInArrow(_deal(held, overlap), schema), "vector-regions")
        lost = lost_pairs(dealt, threshold)
        if lost.empty:
            return dealt
        # every turn joins regions, so there is a last one
        for dim, part in lost.groupby("dim"):
            merge_labels(table[dim][1], part["u"].to_numpy(np.int64), part["v"].to_numpy(np.int64))
        for path in {f.rsplit("/", 1)[0] for f in dealt.inputFiles()}:
            drop_written(spark, path)


# -- the graph of a region --------------------------------------------------------------------
def _pruned(x: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Robust-pruned directed edges among ``members``."""
    n = len(members)
    if n < 2:
        return np.zeros(0, int), np.zeros(0, int)
    y = x[members]
    d = np.maximum(2 - 2 * (y @ y.T), 0)  # squared distances of unit vectors
    np.fill_diagonal(d, np.inf)
    c = min(CANDIDATES, n - 1)
    near = np.argpartition(d, c - 1, axis=1)[:, :c]
    own = np.take_along_axis(d, near, 1)
    order = np.argsort(own, axis=1, kind="stable")
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    alive, row = np.ones((n, c), bool), np.arange(n)
    src, dst = [], []
    for _ in range(min(DEGREE, c)):
        pick = alive.argmax(axis=1)
        has = alive[row, pick]
        if not has.any():
            break
        chosen = near[row, pick]
        src.append(members[row[has]])
        dst.append(members[chosen[has]])
        between = d[chosen[:, None], near]
        alive &= ~(ALPHA * ALPHA * between <= own)
        alive[row, pick] = False
    return np.concatenate(src), np.concatenate(dst)


def graph(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency padded with -1, medoids) of the flat graph over unit vectors ``x``."""
    n = len(x)
    k = max(1, -(-n // CLUSTER))
    c = x[rng.choice(n, k, replace=False)]
    order = np.argsort(-(x @ c.T), axis=1)[:, : min(2, k)]
    src, dst, medoids = [], [], []
    for j in range(k):
        members = np.flatnonzero((order == j).any(axis=1))
        if not len(members):
            continue
        medoids.append(members[(x[members] @ x[members].sum(axis=0)).argmax()])
        # a cluster that is far too large is built as overlapping parts, dealt out twice
        parts = [members]
        if len(members) > 4 * CLUSTER:
            parts = [p for _ in range(2) for p in np.array_split(rng.permutation(members), -(-len(members) // (2 * CLUSTER)))]
        for part in parts:
            a, b = _pruned(x, part)
            src += [a, b]
            dst += [b, a]
    edge = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0) if src else np.zeros((0, 2), int)
    edge = edge[edge[:, 0] != edge[:, 1]]
    # nearest first, so that the degree bound keeps those
    edge = edge[np.lexsort((-(x[edge[:, 0]] * x[edge[:, 1]]).sum(axis=1), edge[:, 0]))]
    slot = np.arange(len(edge)) - np.searchsorted(edge[:, 0], edge[:, 0])
    edge, slot = edge[slot < MAX_DEGREE], slot[slot < MAX_DEGREE]
    adjacency = np.full((n, (int(slot.max()) if len(slot) else 0) + 1), -1)
    adjacency[edge[:, 0], slot] = edge[:, 1]
    return adjacency, np.unique(np.array(medoids))


def search(x: np.ndarray, adjacency: np.ndarray, medoids: np.ndarray, queries: np.ndarray, threshold: float, of: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix, queries (of ``of``, or of ``x``) by vectors: which the greedy search finds at ``threshold``."""
    n, m = len(x), len(queries)
    of = x if of is None else of
    seen = np.full((m, n), -2.0, np.float32)
    open_ = np.full((m, n), -2.0, np.float32)

    def visit(row: np.ndarray, node: np.ndarray) -> None:
        fresh = (node >= 0) & (seen[row, node] < -1.5)
        row, node = row[fresh], node[fresh]
        found = np.einsum("ij,ij->i", of[queries[row]], x[node])
        seen[row, node] = found
        open_[row, node] = found

    everyone = np.arange(m)
    visit(np.repeat(everyone, len(medoids)), np.tile(medoids, m))
    width = adjacency.shape[1]
    for _ in range(STEPS):
        best = open_.argmax(axis=1)
        active = np.flatnonzero(open_[everyone, best] > -1.5)
        if not len(active):
            break
        open_[active, best[active]] = -2.0
        visit(np.repeat(active, width), adjacency[best[active]].ravel())
    low = threshold - SLACK
    while True:
        row, node = np.nonzero(open_ >= low)
        if not len(row):
            return seen >= threshold - 1e-3
        open_[row, node] = -2.0
        for at in range(0, len(row), 4096):
            r, k = row[at : at + 4096], node[at : at + 4096]
            both = np.unique(np.repeat(r, width).astype(np.int64) * (n + 1) + adjacency[k].ravel() + 1)
            visit(both // (n + 1), both % (n + 1) - 1)


def _outright(x: np.ndarray, queries: np.ndarray, threshold: float) -> np.ndarray:
    return (x[queries] @ x.T) >= threshold - 1e-3


def region_links(ids: np.ndarray, x: np.ndarray, copies: np.ndarray, regions: list, region: int, left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, outright: bool = False) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(links counted here, component label, audited links, of them found by the graph) of two blocks of a region.

    ``left`` and ``right`` are positions: the same ones (links inside a block) or different ones.
    """
    n = len(ids)
    counted, label = np.zeros(n, np.int64), np.arange(n)
    if n < 2 or not len(left) or not len(right):
        return counted, label, 0, 0
    inside = np.array_equal(left, right)
    small, other = x.astype(np.float32), x[right]
    near = small[right]
    audited = left[np.argsort((ids[left].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20))][: max(1, len(left) // AUDIT)]
    truth = (small[audited] @ near.T) >= threshold - 1e-3
    if inside:  # none links with itself
        truth[np.arange(len(audited)), np.searchsorted(right, audited)] = False
    wanted = found = int(truth.sum())
    plain = outright or wanted * MAX_DEGREE > truth.size
    if not plain:
        adjacency, medoids = graph(near, np.random.default_rng(SEED + region))
        found = int((truth & search(near, adjacency, medoids, audited, threshold, small)).sum())
        plain = found < MIN_RECALL * wanted
    # the first region that both are in counts the pair: who is in which earlier one
    table = _table(regions)
    before = {r: np.flatnonzero((table[right] == r).any(axis=1)) for r in np.unique(table[(table >= 0) & (table < region)])}
    for low in range(0, len(left), QUERIES):
        some = left[low : low + QUERIES]
        if plain:
            hits = (x[some] @ other.T) >= threshold
        else:
            hits = search(near, adjacency, medoids, some, threshold, small)
            i, j = np.nonzero(hits)
            for at in range(0, len(i), 1 << 18):
                a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                hits[a, b] = np.einsum("ij,ij->i", x[some[a]], other[b]) >= threshold
        if inside:
            hits[np.arange(len(some)), np.arange(low, low + len(some))] = False
        i, j = np.nonzero(hits & (label[some][:, None] != label[right][None, :]))
        merge_labels(label, some[i], right[j])
        own = table[some]
        for r in np.unique(own[(own >= 0) & (own < region)]):
            hits[np.ix_(np.flatnonzero((own == r).any(axis=1)), before[r])] = False
        counted[some] += hits @ copies[right]
        if not inside:
            counted[right] += copies[some] @ hits
    return counted, label, wanted, found


_LINK_SCHEMA = "node long, links long, root long, wanted long, found long"


def _search_region(threshold: float, outright: bool = False):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        ids = rows["node"].to_numpy(np.int64)
        x = _unit(np.array(rows["v"].tolist(), np.float64))
        block = rows["block"].to_numpy(np.int64)
        left, right = np.flatnonzero(block == int(key[2])), np.flatnonzero(block == int(key[3]))
        links, label, wanted, found = region_links(ids, x, rows["copies"].to_numpy(np.int64), [list(r) for r in rows["regions"]], int(key[1]), left, right, threshold, outright)
        out = pd.DataFrame({"node": ids, "links": links, "root": ids[label], "wanted": 0, "found": 0})
        out = out[(out["links"] > 0) | (out["root"] != out["node"])]
        return pd.concat([out, pd.DataFrame({"node": ids[:1], "links": 0, "root": ids[:1], "wanted": wanted, "found": found})])

    return run


def link(grouped: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, region: int = REGION, block: int = BLOCK, outright: bool = False, whole: bool = False) -> DataFrame:
    """(node, links, root, wanted, found) from each region: partial sums, forest edges, audit.

    With ``outright`` no graph is asked, with ``whole`` all vectors of one length are one region.
    """
    if whole:
        ship_package(grouped.sparkSession)
        dealt = grouped.select("node", "copies", "v", F.array(F.lit(0)).alias("regions"))
    else:
        dealt = regions(grouped, threshold, overlap, region)
    dealt = dealt.withColumn("region", F.explode("regions")).withColumn("dim", F.size("v"))
    sizes = dealt.groupBy("dim", "region").count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    tasks = dealt.join(sizes, ["dim", "region"]).withColumn("block", F.pmod("node", F.col("blocks")))
    # each block meets each, so a task holds two of them at most
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    tasks = tasks.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    return tasks.groupBy("dim", "region", "low", "high").applyInPandas(_search_region(threshold, outright), _LINK_SCHEMA)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, least_recall: float = LEAST_RECALL, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of each row of ``vectors``."""
    rows, grouped = classes(vectors)
    rows, grouped = written(rows, "vector-rows"), written(grouped, "vector-classes")
    for ways in ({}, {"outright": True}, {"outright": True, "whole": True}):
        found = written(link(grouped, threshold, **options, **ways), "vector-links")
        per_node = found.groupBy("node").agg(F.sum("links").alias("links"))
        measured = audited_recall(grouped, per_node, threshold)
        if measured >= least_recall:
            break
    joined = components(found.filter("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")), "vectors")
    named = grouped.drop("v").join(per_node, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(ids, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = rows.join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(measured).alias("recall"))


def audited_recall(grouped: DataFrame, per_node: DataFrame, threshold: float = THRESHOLD, audited: int = AUDITED) -> float:
    """Share of the links to other classes found, of a bounded sample of classes with all: linear in the classes."""
    queries = _about(grouped, audited, grouped.count(), F.lit("recall")).select("node", "copies", "v").join(per_node, "node", "left").fillna(0, ["links"]).toPandas()
    if queries.empty:
        return 1.0
    by_length = {d: _unit(np.array(part["v"].tolist())) for d, part in queries.groupby(queries["v"].map(len))}
    held = grouped.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            rows, copies = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            length = np.array(list(map(len, rows)))
            for d, q in held.value.items():
                at = np.flatnonzero(length == d)
                for low in range(0, len(at), 4096):
                    some = at[low : low + 4096]
                    total += int((((q @ _unit(np.array([rows[k] for k in some])).T) >= threshold) @ copies[some]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    true = grouped.select("v", "copies").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    true -= int(queries["copies"].sum())  # each finds its own class
    return min(1.0, float(queries["links"].sum()) / true) if true else 1.0


def recall(vectors: DataFrame, result: DataFrame, every: int = 50, threshold: float = THRESHOLD) -> float:
    """Share of the true links found, of the rows whose id is divisible by ``every``."""
    rows, grouped = classes(vectors)
    queries = rows.join(grouped.select("node", "v"), "node").filter(F.col("vec_id") % every == 0).toPandas()
    if queries.empty:
        return 1.0
    by_length = {d: (part["vec_id"].to_numpy(np.int64), _unit(np.array(part["v"].tolist()))) for d, part in queries.groupby(queries["v"].map(len))}
    held = vectors.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in held.value.items()}
        for batch in batches:
            rows, copies = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            length = np.array(list(map(len, rows)))
            for d, (_, q) in held.value.items():
                at = np.flatnonzero(length == d)
                if len(at):
                    total[d] += ((q @ _unit(np.array([rows[k] for k in at])).T) >= threshold) @ copies[at]
        for d, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(held.value[d][0]), pa.array(n)], ["vec_id", "n"])

    true = grouped.select("v", "copies").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    both = true.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum("n"), F.sum("n_links")).first()
    return both[1] / both[0] if both[0] else 1.0


def digest(vectors: DataFrame) -> DataFrame:
    """Rows of op9."""
    return near_duplicates(vectors)
