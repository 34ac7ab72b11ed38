"""Toxicity by maximum-scoring segments of token log-odds.

*Learning.*  A bounded sample of labelled documents (at most ``max_toxic`` and ``max_clean`` distinct
pairs of id and text, in the order of a hash) gives damped counts of each feature for either label.  The candidates are counted over the whole
corpus, and those counts are the Dirichlet prior of the log-odds (``strength`` pseudo-counts in
corpus proportion); a feature is used if its z value says so.
Features are a word and its beginnings of 4 to 6 letters, so inflections nobody labelled are
known by their stem; a beginning that one longer feature accounts for is left out.  The longest
feature that is used gives a token its score.

*Segments.*  A token scores its log-odds, and every other token costs ``drift``.  One linear scan
finds all maximal-scoring segments: the passages to which no longer or shorter neighbour is
preferable.

*Calibration.*  For scores with a negative mean, the best segment of n background tokens follows
an extreme-value law: the expected number of segments scoring S and more is K n exp(-lambda S).
The sample is dealt into ``FOLDS`` by a hash of the text, and each document is scored with the log-odds
that the other folds give, so what follows is not learned from the texts it describes.
Lambda comes from the clean token scores of the sample (the positive root of E[exp(lambda s)] = 1),
and K from the best segments of its clean documents: K n exp(-lambda S) of a document is exponential with
mean 1, where nothing scores its tail is all that is known, and the likelihood is greatest at the
number of documents with a segment over the sum of n exp(-lambda S).
Segments whose expected number is under a level are passages; their sum's tail
probability is the document's evidence, mapped to a probability by logistic regression on the
sample.  The level is that of ``LEVELS`` at which the regression is likeliest.

Defined results: a null or empty text has no token and gets the probability at no evidence;
repeated rows get equal results; a null doc_id isn't held out; null labels are ignored, and of
several labels of a document the largest counts; a null id has no label, rows of one id and several
texts all have its label, equal ones count once; with no labelled document, one label only, or no feature
to tell them by, every score is 0; a very long text is one scan, and its length is in its calibration; an empty
table gives none; other columns are carried by ``score`` and ``clean`` under any names, but for
those named evidence, score and passages, which ``score`` replaces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package, written

MAX_TOXIC, MAX_CLEAN = 8_000, 16_000
PREFIXES = (4, 5, 6)
MIN_DOCS, MIN_Z, PRIOR_SHARE, DIVERSE = 3, 3.0, 0.1, 1.3
#: What each token that says nothing costs.
DRIFT = 0.25
#: Expected numbers of chance passages in a clean document, of which the sample chooses the one that a passage
#: stays under; and the folds it is dealt into.
LEVELS, FOLDS = (1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6), 5
HELD_OUT = 2
THRESHOLD = 0.3
STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_"
#: Distinct words that a worker keeps counts or scores of at once.
MEMO = 100_000
#: Entries of counts, or of words looked up, at once.
HELD = 50_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))


def features(word: str) -> tuple[str, ...]:
    """The word without marks around it, and its beginnings (marked by a trailing star)."""
    word = word.strip(STRIP)
    if not word:
        return ()
    return (word, *(word[:n] + "*" for n in reversed(PREFIXES) if len(word) >= n))


@dataclass
class Model:
    scores: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature: (z, log-odds)
    lam: float = 1.0
    k: float = 0.1
    intercept: float = -20.0
    slope: float = 0.0
    level: float = 1e-4
    empty: bool = True

    def token(self, raw: str) -> float:
        return next((self.scores[f][1] for f in features(raw) if f in self.scores), 0.0)

    def evidence(self, segments: list[tuple[int, int, float]], tokens: int, level: float | None = None) -> tuple[float, list[tuple[int, int, float]]]:
        """(-log10 of the tail probability, significant passages)."""
        n = max(tokens, 1)
        level = self.level if level is None else level
        passages = [s for s in segments if self.k * n * math.exp(-min(700.0, self.lam * s[2])) < level]
        total = self.lam * sum(s[2] for s in passages)
        if not passages:
            return 0.0, []
        # K n exp(-x) expected; for small ones the probability is the expected number
        expected = math.log(self.k * n) * len(passages) - total - math.lgamma(len(passages) + 1)
        return min(60.0, max(0.0, -expected / math.log(10))), passages

    def probability(self, evidence: float) -> float:
        if self.empty:
            return 0.0
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, self.intercept + self.slope * evidence))))


def segments(at: list[int], score: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) in linear time.

    ``at`` are the places of the tokens that score above 0, in order; each token between costs
    ``drift``.  Candidates stand on a stack with the running totals before and after them; one
    that ends lower than a new one joins it if the stretch from its start up is ahead.
    """
    stack: list[list] = []  # first, last, total before, total after
    total, previous = 0.0, -1
    for place, gain in zip(at, score):
        total -= drift * (place - previous - 1)
        before, total, previous = total, total + gain, place
        now = [place, place, before, total]
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= now[2]:
                k -= 1
            if k < 0 or stack[k][3] >= now[3]:
                break
            now = [stack[k][0], now[1], stack[k][2], now[3]]
            del stack[k:]
        stack.append(now)
    return [(a, b, after - before) for a, b, before, after in stack]


def _logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge."""
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (count * (y - p)) - 0.01 * w
        hessian = (design * (count * (p * (1 - p) + 1e-9))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _decay(background: Counter) -> float:
    """The positive root of E[exp(lambda s)] = 1 over (score, tokens) of clean text."""
    total = sum(background.values())
    pairs = [(s, n / total) for s, n in background.items()]
    if total == 0 or sum(s * p for s, p in pairs) >= 0 or not any(s > 0 for s, _ in pairs):
        return 1.0

    def excess(lam: float) -> float:
        return sum(p * math.exp(min(700.0, lam * s)) for s, p in pairs) - 1.0

    low, high = 0.0, 1.0
    while excess(high) < 0:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _scale(lam: float, best: list[tuple[float, int]]) -> float:
    """K from (best segment score, tokens) of clean text; a half more of each side keeps it positive."""
    seen = sum(1 for s, _ in best if s > 0)
    mass = sum(n * math.exp(-min(700.0, lam * s)) for s, n in sorted(best))
    return (seen + 0.5) / (mass + 1.0)


# -- learning ---------------------------------------------------------------------------------
def sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(toxic, text, fold): the bounded sample of distinct rows; none that is held out."""
    named = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    named = named.filter(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id"))
    # at most max_toxic + max_clean ids: small enough to broadcast, so that no text is shuffled
    size = {1: max_toxic, 0: max_clean}
    parts = [named.filter(F.col("toxic") == y).orderBy("turn", "doc_id").limit(n) for y, n in size.items()]
    chosen = written(parts[0].union(parts[1]).drop("turn"), "toxicity-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").withColumn("turn", F.xxhash64("doc_id", "text"))
    # an id may have any number of rows: of those, too, the first by a hash, found without texts
    turns = rows.select("toxic", "turn").distinct()
    cuts = [turns.filter(F.col("toxic") == y).orderBy("turn").limit(n) for y, n in size.items()]
    last = cuts[0].union(cuts[1]).groupBy("toxic").agg(F.max("turn").alias("last"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    near = rows.join(F.broadcast(last), "toxic").filter(F.col("turn") <= F.col("last"))
    return near.dropDuplicates(["toxic", "turn"]).select("toxic", "text", fold.alias("fold"))


def _counts(labelled: bool, wanted: set[str] | None):
    """Per partition: (fold, toxic, feature, weight, docs); the feature "" has the words of all texts.

    A document's n-th mention of a feature counts less than the one before (log2(1 + n) for n):
    a text that repeats itself is no evidence of many.  With ``wanted``, those features alone.
    Without, what is held is flushed at ``HELD`` entries; with them it is no more than they are, and each
    partition gives a feature once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight: dict[tuple[int, int, str], list] = {}
        memo: dict[str, tuple[str, ...]] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(weight), list(weight.values())
            weight.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.string()),
                    pa.array([v[0] for v in values], pa.float64()),
                    pa.array([v[1] for v in values], pa.int64()),
                ],
                ["fold", "toxic", "feature", "weight", "docs"],
            )

        for batch in batches:
            marks = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if labelled else [(0, 0)] * batch.num_rows
            for text, (fold, y) in zip(batch.column(0), marks):
                words = Counter((text.as_py() or "").lower().split())
                here: dict[str, int] = {}
                for w, n in words.items():
                    found = memo.get(w)
                    if found is None:
                        found = features(w) if wanted is None else tuple(f for f in features(w) if f in wanted)
                        if wanted is not None:
                            if len(memo) >= HELD:
                                memo.clear()
                            memo[w] = found
                    for f in found:
                        here[f] = here.get(f, 0) + n
                for f, x in [("", float(len(words))), *((f, math.log2(1 + n)) for f, n in here.items())]:
                    held = weight.get((fold, y, f))
                    if held is None:
                        weight[(fold, y, f)] = [x, 1]
                    else:
                        held[0] += x
                        held[1] += 1
                if wanted is None and len(weight) >= HELD:
                    yield flush()
        yield flush()

    return run


_COUNT_SCHEMA = "fold int, toxic int, feature string, weight double, docs long"


def _exact_sum(column: str) -> Column:
    """A sum that no order of the rows changes: in 2**-20ths, as integers."""
    return F.sum(F.round(F.col(column) * (1 << 20)).cast("long")) / (1 << 20)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    spark = docs.sparkSession
    ship_package(spark)
    rows = written(sample(docs, labels, max_toxic, max_clean), "toxicity-sample")
    counted = rows.select("text", "fold", "toxic").mapInArrow(_counts(True, None), _COUNT_SCHEMA)
    counted = written(counted.groupBy("fold", "toxic", "feature").agg(_exact_sum("weight").alias("weight"), F.sum("docs").alias("docs")), "toxicity-counts")
    words = {(r.fold, r.toxic): r.weight for r in counted.filter("feature = ''").collect()}
    # what is learned from: all folds, and all but one
    parts = [None, *range(FOLDS)]
    size = {p: {y: sum(w for (fold, label), w in sorted(words.items()) if label == y and fold != p) for y in (0, 1)} for p in parts}
    if not size[None][0] or not size[None][1]:
        return Model()

    def name(column: str, y: int, part: int | None) -> str:
        return f"{column}{y}" if part is None else f"{column}{y}_{part}"

    def among(y: int, part: int | None) -> Column:
        return (F.col("toxic") == y) if part is None else (F.col("toxic") == y) & (F.col("fold") != part)

    both = counted.filter("feature <> ''").groupBy("feature").agg(
        *[F.sum(F.when(among(y, p), F.col(c)).otherwise(0)).alias(name(c, y, p)) for p in parts for y in (0, 1) for c in ("weight", "docs")]
    )

    # candidates: over-represented in toxic text, and not by chance of a document or two; the
    # sample's size bounds them
    def candidate(part: int | None) -> Column:
        if not size[part][0] or not size[part][1]:
            return F.lit(False)
        rate = (F.col(name("weight", 1, part)) + 0.5) / size[part][1] / ((F.col(name("weight", 0, part)) + 0.5) / size[part][0])
        return (F.col(name("docs", 1, part)) >= MIN_DOCS) & (rate > 1.5)

    marked = both.select("*", *[candidate(p).alias(name("candidate", 0, p)) for p in parts])
    found = marked.filter(" or ".join(name("candidate", 0, p) for p in parts)).orderBy("feature").toPandas()
    if not found[name("candidate", 0, None)].any():
        return Model()
    # the prior: the same features over the whole corpus
    wanted = spark.sparkContext.broadcast(set(found["feature"]))

    def corpus(batches):
        return _counts(False, wanted.value)(batches)

    prior = docs.select(F.col("text").cast("string")).mapInArrow(corpus, _COUNT_SCHEMA).groupBy("feature").agg(_exact_sum("weight").alias("n")).toPandas().set_index("feature")["n"]
    scores = {}
    for p in parts:
        own = found[found[name("candidate", 0, p)]]
        columns = {name(c, y, p): f"{c}{y}" for y in (0, 1) for c in ("weight", "docs")}
        scores[p] = _log_odds(own[["feature", *columns]].rename(columns=columns), prior, size[p]) if len(own) else {}
    if not scores[None]:
        return Model()
    model = Model(scores[None], empty=False)
    _calibrate(model, [Model(scores[p], empty=False) for p in range(FOLDS)], rows)
    return model


def _log_odds(found: pd.DataFrame, prior: pd.Series, size: dict[int, int]) -> dict[str, tuple[float, float]]:
    strength = PRIOR_SHARE * (size[0] + size[1])
    a = strength * (prior.reindex(found["feature"]).fillna(0).to_numpy(float) + 0.5) / (float(prior.get("", 0)) + 1)
    toxic, clean = found["weight1"].to_numpy(float) + a, found["weight0"].to_numpy(float) + a
    delta = np.log(toxic / (size[1] + strength - toxic)) - np.log(clean / (size[0] + strength - clean))
    z = delta / np.sqrt(1 / toxic + 1 / clean)
    found = found.assign(z=z, delta=delta)
    found = found[(found["z"] >= MIN_Z) & (found["delta"] > DRIFT)]
    # a beginning must know more documents than any one longer feature that has it
    known: dict[str, int] = {}
    alone = set()
    for f, n in sorted(zip(found["feature"], found["docs1"]), key=lambda x: (-len(x[0].rstrip("*")), x[0].endswith("*"))):
        if f.endswith("*") and known.get(f[:-1], 0) * DIVERSE >= n:
            alone.add(f)
        for k in range(min(PREFIXES), len(f.rstrip("*")) + 1):
            known[f[:k]] = max(known.get(f[:k], 0), n)
    found = found[~found["feature"].isin(alone)]
    return {f: (float(zz), float(d)) for f, zz, d in zip(found["feature"], found["z"], found["delta"])}


def _scan(model: Model, text: str | None, memo: dict[str, float]) -> tuple[int, list[int], list[float]]:
    words = (text or "").lower().split()
    at, gain = [], []
    for i, w in enumerate(words):
        s = memo.get(w)
        if s is None:
            if len(memo) > MEMO:
                memo.clear()
            s = memo[w] = model.token(w)
        if s:
            at.append(i)
            gain.append(s)
    return len(words), at, gain


def _calibrate(model: Model, others: list[Model], rows: DataFrame) -> None:
    """lambda, K, the level, and the map from evidence to probability, on the sample (bounded rows).

    Each row is scored with that of ``others`` which didn't learn from its fold.
    """
    held = rows.sparkSession.sparkContext.broadcast(others)

    def scans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memos: list[dict[str, float]] = [{} for _ in held.value]
        for batch in batches:
            for text, y, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield y, fold, *_scan(held.value[fold], text.as_py(), memos[fold])

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        best: Counter = Counter()
        for y, _, n, at, gain in scans(batches):
            if y == 0:
                count.update(round(g, 3) for g in gain)
                count[-DRIFT] += n - len(gain)
                best[max((x[2] for x in segments(at, gain)), default=0.0)] += n
        found = [(False, k, v) for k, v in count.items()] + [(True, k, v) for k, v in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.bool_()), pa.array([r[1] for r in found], pa.float64()), pa.array([r[2] for r in found], pa.int64())], ["best", "s", "n"])

    sampled = rows.select("text", "toxic", "fold")
    found = sampled.mapInArrow(scores, "best boolean, s double, n long").groupBy("best", "s").agg(F.sum("n").alias("n")).collect()
    background = Counter({r.s: r.n for r in found if not r.best})
    # what no clean document of the sample holds still has a chance: half a token each
    for z, delta in model.scores.values():
        background[round(delta, 3)] += 0.5 / max(1, len(model.scores))
    model.lam = _decay(background)
    model.k = _scale(model.lam, [(r.s, r.n) for r in found if r.best])
    lam, k = model.lam, model.k

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, strength = [], []
        for y, fold, n, at, gain in scans(batches):
            own = Model(lam=lam, k=k)
            passages = segments(at, gain)
            toxic.append(y)
            strength.append([own.evidence(passages, n, level)[0] for level in LEVELS])
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(strength, pa.list_(pa.float64()))], ["toxic", "evidence"])

    scored = sampled.mapInArrow(evidence, "toxic int, evidence array<double>").groupBy("toxic", "evidence").count().toPandas()
    if scored.empty:
        return
    model.level, model.intercept, model.slope = _choose(np.array(scored["evidence"].tolist(), dtype=float), scored["toxic"].to_numpy(float), scored["count"].to_numpy(float))


def _choose(evidence: np.ndarray, toxic: np.ndarray, count: np.ndarray) -> tuple[float, float, float]:
    """(level, intercept, slope): the level whose evidence tells the labels best; of equal ones the strictest."""
    order = np.lexsort((toxic, *evidence.T))
    evidence, toxic, count = evidence[order], toxic[order], count[order]
    best, chosen = -math.inf, (LEVELS[-1], 0.0, 0.0)
    for level, x in sorted(zip(LEVELS, evidence.T), key=lambda pair: pair[0]):
        intercept, slope = _logistic(x, toxic, count)
        z = intercept + slope * x
        likelihood = -float((count * np.logaddexp(0.0, np.where(toxic > 0, -z, z))).sum())
        if likelihood > best + 1e-9:
            best, chosen = likelihood, (level, intercept, slope)
    return chosen


# -- scoring ----------------------------------------------------------------------------------
ADDED = ("evidence", "score", "passages")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with evidence, score and passages (first and last token, segment score)."""
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # bounded: features of the bounded sample
    at_column = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c not in ADDED]
    names = [*(docs.columns[i] for i in kept), *ADDED]
    from pyspark.sql import types as T

    passage = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("evidence", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("passages", passage)])
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = held.value, {}
        for batch in batches:
            evidence, probability, passages = [], [], []
            for value in batch.column(at_column):
                n, at, gain = _scan(model, value.as_py(), memo)
                e, found = model.evidence(segments(at, gain), n)
                evidence.append(e)
                probability.append(model.probability(e))
                passages.append([{"first": a, "last": b, "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(evidence, pa.float64()), pa.array(probability, pa.float64()), pa.array(passages, arrow)],
                names=names,
            )

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of op3."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = score(texts, fit(texts, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; no column is changed."""
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels)
    renamed = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    kept = score(renamed, model, f"_c{docs.columns.index('text')}").filter(F.col("score") < THRESHOLD)
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
