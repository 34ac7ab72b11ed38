"""Gradient boosting with leaf-wise trees over histograms that executors sum.

*Groups.*  Features are binned once by quantiles of all rows.  Trees know rows by their bins alone, so rows of equal bins and label have the same
margin in every round and are one group that weighs as many.

*Histograms.*  Gradients, curvatures and rows are summed by (node, feature, bin).  Gradients are integers (in units of ``1 / UNIT``), so sums don't
depend on how rows fall into tasks, and neither does a tree.  Of two children the one of fewer groups (in a pass: rows) is summed; the other's sums are what is left of their parent's.

*Best first.*  A tree grows by the split with the largest gain, wherever it is, until it has all its leaves.

*One task.*  Up to ``MANY`` groups, one byte a feature, are held by one task, which grows all trees: a job for each level of each tree would cost more than the sums themselves.

*Passes.*  More groups are summed by passes, of which the driver sees at most ``leaves * features * BINS`` sums each.  Which split is next can depend
on nodes that no histogram is known of yet; then one pass sums those of all nodes that may still be split, so a tree takes about as many
passes as it has levels, not one per leaf, and is the tree that one at a time would give.  Groups are written with their margin every ``REWRITE``
rounds, trees since then are applied in the pass itself.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import drop_written, ship_package, written

#: Bins of a feature, units of a gradient, rounds of passes after which margins are written.
BINS, UNIT, REWRITE = 255, 1 << 20, 1
#: Groups that one task holds, at about 50 bytes each, and of which it has temporary columns at once.
MANY, BLOCK = 20_000_000, 1 << 16
#: Least rows and least curvature of a leaf.
LEAST_ROWS, LEAST_CURVATURE = 20, 1e-3


@dataclass
class Tree:
    """Nodes as arrays, the root first: a row goes left where its bin is at most ``cut``; leaves have no feature (-1)."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            node = at[inner]
            goes_left = bins[inner, self.feature[node]] <= self.cut[node]
            at[inner] = np.where(goes_left, self.left[node], self.right[node])
            inner = inner[self.feature[at[inner]] >= 0]
        return at


@dataclass
class Boosted:
    """A fitted model: where the margin starts, trees, and the upper bounds of each feature's bins."""

    columns: list[str]
    start: float
    bounds: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(b, x) for b, x in zip(self.bounds, columns)], 1) if columns else np.zeros((0, 0), np.int64)

    def margins(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """``rows`` with their margin: the log-odds of label 1."""
        ship_package(rows.sparkSession)
        kept = [c for c in rows.columns if c != name]
        source = rows.select(*kept, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.columns)])
        width, out_names = len(kept), [*kept, name]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = self.binned([c.to_numpy(zero_copy_only=False) for c in batch.columns[width:]])
                margin = np.full(batch.num_rows, self.start)
                for tree in self.trees:
                    margin += tree.value[tree.leaves(bins)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(margin)], names=out_names)

        return source.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))


@dataclass
class _Node:
    """A node of the tree that is growing; ``place`` numbers nodes as in a heap, so it doesn't depend on when one is made."""

    place: int
    sums: np.ndarray | None = None  # (features, bins, 3)
    gain: float = 0.0
    feature: int = -1
    cut: int = -1
    children: tuple | None = None


def best_split(sums: np.ndarray, least_rows: int = LEAST_ROWS) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a node's sums; of equal ones the first feature's first bin."""
    total = sums[0].sum(0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = total - left
    fits = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= LEAST_CURVATURE * UNIT) & (right[..., 1] >= LEAST_CURVATURE * UNIT)
    g, h = left[..., 0].astype(float), left[..., 1].astype(float)
    k, m = right[..., 0].astype(float), right[..., 1].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, g * g / h + k * k / m - float(total[0]) ** 2 / float(total[1]), -np.inf)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    return (float(gain[f, b]), f, b) if gain[f, b] > 0 else (0.0, -1, -1)


def _grown(root: _Node, leaves: int) -> tuple[list[_Node], bool]:
    """The nodes split best first, and whether that is all of them; else a node on the way has children without sums."""
    heap, done = [(-root.gain, root.place, root)], []
    while heap and len(done) < leaves - 1:
        _, _, node = heapq.heappop(heap)
        if node.feature < 0:
            continue
        if node.children is None or node.children[0].sums is None:
            return done, False
        done.append(node)
        for child in node.children:
            heapq.heappush(heap, (-child.gain, child.place, child))
    return done, True


def _flat(root: _Node, inner: set[int], value) -> tuple[Tree, list[_Node]]:
    """The tree whose inner nodes have the places given, and its nodes in order."""
    nodes, at = [root], 0
    rows = []
    while at < len(nodes):
        node = nodes[at]
        if node.place in inner:
            rows.append((node.feature, node.cut, len(nodes), len(nodes) + 1, 0.0))
            nodes += node.children
        else:
            rows.append((-1, -1, -1, -1, value(node)))
        at += 1
    columns = [np.array(c) for c in zip(*rows)]
    return Tree(*columns), nodes


def _value(rate: float):
    """A leaf's value, out of its node's sums."""

    def value(node: _Node) -> float:
        g, h, _ = node.sums[0].sum(0).tolist()
        return -rate * g / h

    return value


def _slopes(label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of a row of each group, whole numbers: sums of them below 2^53 are exact."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - label) * UNIT), np.rint(p * (1.0 - p) * UNIT)


def _histograms(rows: DataFrame, features: int, tree: Tree, wanted: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Sums of (gradient, curvature, rows) by (wanted node, feature, bin); ``wanted`` is a node's number among those, or -1."""
    nodes = int(wanted.max()) + 1
    bins = BINS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, nodes * features * bins), np.int64)
        for batch in batches:
            x, label, n = _read(batch, features)
            node = wanted[tree.leaves(x)]
            some = node >= 0
            at = ((node[some, None] * features + np.arange(features)) * bins + x[some]).ravel()
            g, h = _slopes(label, _margin(batch, x, trees))
            for k, weight in enumerate((g * n, h * n, n)):
                total[k] += np.bincount(at, np.repeat(weight[some], features), total.shape[1]).astype(np.int64)
        cells = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array(t[cells]) for t in total)], names=["cell", "g", "h", "n"])

    summed = rows.mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toPandas()
    out = np.zeros((nodes * features * bins, 3), np.int64)
    out[summed["cell"]] = summed[["g", "h", "n"]].to_numpy()
    return out.reshape(nodes, features, bins, 3)


def _read(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, label and rows of each group."""
    words = np.stack([batch.column(f"w{k}").to_numpy() for k in range(_words(features))], 1)
    return words.view(np.uint8)[:, :features], batch.column("label").to_numpy(), batch.column("n").to_numpy()


def _margin(batch: pa.RecordBatch, x: np.ndarray, trees: list[Tree]) -> np.ndarray:
    margin = batch.column("margin").to_numpy().copy()
    for tree in trees:
        margin += tree.value[tree.leaves(x)]
    return margin


def _words(features: int) -> int:
    """Longs that a group's bins take, eight each."""
    return max(1, -(-features // 8))


def _groups(rows: DataFrame, model: Boosted, label: str) -> DataFrame:
    """A row for each label and combination of bins, with the number ``n`` of its rows."""
    source = rows.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(model.columns)], F.col(label).cast("double").alias("label"))
    names = [f"w{k}" for k in range(_words(len(model.columns)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.zeros((batch.num_rows, 8 * len(names)), np.uint8)
            bins[:, : len(model.columns)] = model.binned([c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]])
            yield pa.RecordBatch.from_arrays([batch.columns[-1], *(pa.array(w) for w in bins.view(np.int64).T)], names=["label", *names])

    binned = source.mapInArrow(run, ", ".join(["label double", *(f"{w} long" for w in names)]))
    return written(binned.groupBy("label", *names).agg(F.count(F.lit(1)).alias("n")), "boost-groups")


def _rewritten(rows: DataFrame, features: int, trees: list[Tree]) -> DataFrame:
    """``rows`` with their margins up to date, instead of those they are read from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margin(batch, _read(batch, features)[0], trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin)], names=batch.schema.names)

    now = written(rows.mapInArrow(run, rows.schema), "boost-rows")
    for path in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        drop_written(rows.sparkSession, path)
    return now


def _blocks(at: np.ndarray) -> Iterator[np.ndarray]:
    return (at[first : first + BLOCK].astype(np.intp) for first in range(0, len(at), BLOCK))


def _sums(x: np.ndarray, at: np.ndarray, slopes: tuple[np.ndarray, np.ndarray], n: np.ndarray) -> np.ndarray:
    """Sums of the groups ``at`` by (feature, bin)."""
    out = np.zeros((len(x), 3, BINS + 1))
    for some in _blocks(at):
        rows = n.take(some).astype(float)
        weights = (*(s.take(some) * rows for s in slopes), rows)
        for f, column in enumerate(x):
            bins = column.take(some).astype(np.intp)
            for k, w in enumerate(weights):
                out[f, k] += np.bincount(bins, w, BINS + 1)
    return out.astype(np.int64).transpose(0, 2, 1)


def _tree(x: np.ndarray, every: np.ndarray, slopes: tuple[np.ndarray, np.ndarray], n: np.ndarray, leaves: int, rate: float, least_rows: int) -> tuple[Tree, list[tuple[np.ndarray, float]]] | None:
    """A tree of groups at hand, numbered by ``every``, and the groups of each leaf with its value; None if nothing can be split."""
    root = _Node(1, _sums(x, every, slopes, n))
    root.gain, root.feature, root.cut = best_split(root.sums, least_rows)
    heap, inner, groups = [(-root.gain, root.place, root)], set(), {root.place: every}
    while heap and len(inner) < leaves - 1:
        _, _, node = heapq.heappop(heap)
        if node.feature < 0:
            continue
        inner.add(node.place)
        at = groups.pop(node.place)
        goes_left = np.concatenate([x[node.feature].take(some) <= node.cut for some in _blocks(at)])
        sides = [at[goes_left], at[~goes_left]]
        few = int(len(sides[1]) < len(sides[0]))
        sums = _sums(x, sides[few], slopes, n)
        node.children = tuple(_Node(2 * node.place + k, sums if k == few else node.sums - sums) for k in (0, 1))
        for child, side in zip(node.children, sides):
            groups[child.place] = side
            child.gain, child.feature, child.cut = best_split(child.sums, least_rows)
            heapq.heappush(heap, (-child.gain, child.place, child))
    if not inner:
        return None
    tree, nodes = _flat(root, inner, _value(rate))
    return tree, [(groups[node.place], value) for node, value in zip(nodes, tree.value) if node.place not in inner]


_TREE = "feature array<long>, cut array<long>, left array<long>, right array<long>, value array<double>"


def _grown_in_one_task(groups: DataFrame, model: Boosted, rounds: int, rate: float, leaves: int, least_rows: int) -> list[Tree]:
    features, start = len(model.columns), model.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.T.copy(), label.astype(np.int8), n) for x, label, n in (_read(batch, features) for batch in batches)]
        x, label, n = (np.concatenate(p, axis=-1) for p in zip(*parts))
        del parts
        n = n.astype(np.min_scalar_type(n.max()))
        every, margin = np.arange(len(n), dtype=np.int32), np.full(len(n), start)
        slopes = np.empty(len(n), np.int32), np.empty(len(n), np.int32)
        for _ in range(rounds):
            for some in _blocks(every):
                slopes[0][some], slopes[1][some] = _slopes(label[some], margin[some])
            grown = _tree(x, every, slopes, n, leaves, rate, least_rows)
            if grown is None:
                return
            tree, found = grown
            for leaf, value in found:
                for some in _blocks(leaf):
                    margin[some] += value
            yield pa.RecordBatch.from_arrays([pa.array([c.tolist()]) for c in vars(tree).values()], names=list(vars(tree)))

    return [Tree(*map(np.array, r)) for r in groups.coalesce(1).mapInArrow(run, _TREE).collect()]


def bin_bounds(rows: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of each column's bins: its different values if they are few, else quantiles of all rows."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(s) for s in shares]), 10_000).alias(f"_b{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(b if b is not None else [0.0])) for b in found]


def fit(rows: DataFrame, columns: list[str], label: str = "label", rounds: int = 200, rate: float = 0.1, leaves: int = 31, least_rows: int = LEAST_ROWS, bins: int = BINS) -> Boosted:
    """Boosted trees on ``columns`` (numbers without nulls) for a label of 0 and 1; a table of one class gets no tree."""
    ship_package(rows.sparkSession)
    n, positive = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    if not n or not positive or positive == n:
        return Boosted(list(columns), math.log((positive or 0) + 0.5) - math.log(n - (positive or 0) + 0.5), [np.zeros(1)] * len(columns))
    model = Boosted(list(columns), math.log(positive / (n - positive)), bin_bounds(rows, columns, min(bins, BINS)))
    groups = _groups(rows, model, label)
    if groups.count() <= MANY:
        model.trees = _grown_in_one_task(groups, model, rounds, rate, leaves, least_rows)
        return model
    data = groups.withColumn("margin", F.lit(model.start))
    pending: list[Tree] = []
    for _ in range(rounds):
        if len(pending) >= REWRITE:
            data, pending = _rewritten(data, len(columns), pending), []
        root = _Node(1)
        new, rest = [root], []
        done, whole = [], False
        while not whole:
            tree, nodes = _flat(root, _inner(root), lambda node: 0.0)
            number = {id(node): k for k, node in enumerate(new)}
            sums = _histograms(data, len(columns), tree, np.array([number.get(id(node), -1) for node in nodes]), pending)
            for node, s in zip(new, sums):
                node.sums = s
            for node, parent, sibling in rest:
                node.sums = parent.sums - sibling.sums
            for node in [*new, *(r[0] for r in rest)]:
                s = node.sums
                node.gain, node.feature, node.cut = best_split(s, least_rows)
            done, whole = _grown(root, leaves)
            if not whole:
                open_ = sorted((x for x in nodes_of(root) if x.children is None and x.feature >= 0), key=lambda x: (-x.gain, x.place))[:leaves]
                for node in open_:
                    node.children = (_Node(2 * node.place), _Node(2 * node.place + 1))
                new, rest = [], []
                for node in open_:
                    left = int(node.sums[node.feature, : node.cut + 1, 2].sum())
                    few, many = node.children if 2 * left <= int(node.sums[node.feature, :, 2].sum()) else node.children[::-1]
                    new.append(few)
                    rest.append((many, node, few))
        if not done:
            break
        tree, _ = _flat(root, {node.place for node in done}, _value(rate))
        model.trees.append(tree)
        pending.append(tree)
    return model


def nodes_of(root: _Node) -> list[_Node]:
    found = [root]
    for node in found:
        found += node.children or ()
    return found


def _inner(root: _Node) -> set[int]:
    return {node.place for node in nodes_of(root) if node.children}
