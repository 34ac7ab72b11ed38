"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability
of a word (with its start mark) is the sum over all its segmentations into pieces, which the
forward algorithm gives in one pass over its characters; a text's is the product over its words.
Probabilities are learned by expectation-maximisation (forward and backward sums) on the word
counts of a bounded sample per language (``per_language`` distinct pairs of id and text, in the
order of a hash of both); everything else sees whole texts of all rows.

Words are scored in batches: all words of one length at once, each substring being looked up by
its rolling hash in the sorted hashes of the vocabulary.  Words of more than ``STRETCH`` characters
are scored whole as well, with rescaled sums that keep the last characters only; they are learned
from in stretches.  A worker keeps the scores of up to ``MEMO`` words, since most tokens are words
it has met.

Defined results: ``und`` with score 0 for a null text, one without a letter, and for all if
there is nothing to learn from; repeated rows get equal results and are learned from once; a null
doc_id isn't held out; of equally likely languages the first by code point is predicted;
an empty table gives none; a very long text is the sum over its words, each of any length; other
columns are not inputs and are carried by ``predict`` under any names, but for those named
lang_pred and score, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship_package

PER_LANGUAGE = 500
ROUNDS, SMOOTHING = 4, 0.05
UNDETERMINED = "und"
HELD_OUT = 0
#: Characters of a word that is scored without rescaling, and of a stretch that is learned from.
STRETCH = 48
MEMO = 200_000
#: Likelihoods below this are summed in logarithms.
TINY = 1e-200
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: White space that ends a word.
_TRIM = str.maketrans({c: " " for c in ".,;:!?\"'()[]{}*#$%&|<>"})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == HELD_OUT, F.lit(False))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str | None = None) -> list[str]:
    """Pieces of the vocabulary that lower-case text can use."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return sorted({p for p in found if p == p.lower() and (len(p) == 1 or MARK not in p[1:])})


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


class Lattice:
    """Look-up of substrings in a fixed set of pieces, for many words at once."""

    def __init__(self, vocabulary: list[str]):
        self.longest = max(map(len, vocabulary), default=1)
        self.size = len(vocabulary) + 1  # the last is any single character outside it
        key, number = [], []
        for length in sorted({len(p) for p in vocabulary}):
            some = [(i, p) for i, p in enumerate(vocabulary) if len(p) == length]
            key.append(self._hash(_codes([p for _, p in some], length), length))
            number.append(np.array([i for i, _ in some], np.int32))
        keys, numbers = np.concatenate(key), np.concatenate(number)
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], numbers[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")

    @staticmethod
    def _hash(codes: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(codes), length, np.uint64)
        for k in range(length):
            h = (h ^ codes[:, k]) * _BASE
            h ^= h >> np.uint64(29)
        return h

    def _find(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Piece number of each row, or -1; a character outside the vocabulary has the last number."""
        h = self._hash(codes, length)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, self.numbers[at], self.size - 1 if length == 1 else -1)

    def numbers_at(self, codes: np.ndarray) -> np.ndarray:
        """Piece numbers of all substrings: by length less 1, word and start (-1: none)."""
        out = np.full((self.longest, *codes.shape), -1, np.int32)
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            windows = np.lib.stride_tricks.sliding_window_view(codes, length, axis=1)
            out[length - 1, :, : windows.shape[1]] = self._find(windows.reshape(-1, length), length).reshape(windows.shape[:2])
        return out

    def arcs(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, piece number or -1 for each word) of every substring that some word has."""
        n, out = codes.shape[1], []
        for start in range(n):
            for end in range(start + 1, min(n, start + self.longest) + 1):
                number = self._find(codes[:, start:end], end - start)
                if (number >= 0).any():
                    out.append((start, end, number))
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    length = np.array([len(w) for w in words])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        for low in range(0, len(at), 4096):
            some = at[low : low + 4096]
            yield some, _codes([words[i] for i in some], int(n))


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[str]
    probability: np.ndarray  # pieces and the unknown one, by language
    prior: np.ndarray  # log

    def __post_init__(self):
        self.lattice = Lattice(self.vocabulary)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "lattice"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word by language."""
        out = np.zeros((len(words), len(self.languages)))
        table = np.vstack([self.probability, np.zeros(len(self.languages))])  # -1: none
        short = [k for k, w in enumerate(words) if len(w) <= STRETCH]
        rest = [k for k, w in enumerate(words) if len(w) > STRETCH]
        for at, codes in _by_length([words[k] for k in short]):
            n = codes.shape[1]
            forward = np.zeros((n + 1, len(at), len(self.languages)))
            forward[0] = 1.0
            for start, end, number in self.lattice.arcs(codes):
                forward[end] += forward[start] * table[number]
            at = np.array(short)[at]
            tiny = (forward[n] < 1e-250).any(axis=1)
            out[at[~tiny]] = np.log(forward[n][~tiny])
            rest += at[tiny].tolist()
        rest.sort(key=lambda k: len(words[k]))
        for low in range(0, len(rest), 64):
            out[rest[low : low + 64]] = self._rescaled([words[k] for k in rest[low : low + 64]], table)
        return out

    def _rescaled(self, words: list[str], table: np.ndarray, part: int = 2048) -> np.ndarray:
        """The same of words of any length: sums of the last characters, divided by their latest."""
        longest, langs = self.lattice.longest, len(self.languages)
        length = np.array(list(map(len, words)))
        out, scale = np.zeros((len(words), langs)), np.zeros((len(words), langs))
        ring = np.zeros((longest, len(words), langs))
        ring[0] = 1.0
        for low in range(0, int(length.max()), part):
            high, first = min(low + part, int(length.max())), max(0, low - longest + 1)
            codes = _codes([w[first:high].ljust(high - first, "\0") for w in words], high - first)
            numbers = self.lattice.numbers_at(codes)
            for end in range(low + 1, high + 1):
                back = np.arange(1, min(longest, end) + 1)
                now = (ring[(end - back) % longest] * table[numbers[back - 1, :, end - back - first]]).sum(axis=0)
                ring[end % longest] = now
                if end % 8 == 0:
                    scale += np.log(now)
                    ring /= now.copy()
                done = np.flatnonzero(length == end)
                if len(done):
                    out[done] = np.log(ring[end % longest][done]) + scale[done]
        return out


def words_of(text: str) -> list[str]:
    """Marked lower-case words."""
    return [MARK + w for w in text.lower().translate(_TRIM).split()]


def stretches(words: list[str]) -> Iterator[str]:
    """Words, those that are very long in stretches."""
    for w in words:
        for k in range(0, len(w), STRETCH):
            yield w[k : k + STRETCH]


# -- learning ---------------------------------------------------------------------------------
def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most ``per_language`` distinct rows of each language; none held out.

    Rows are told apart by id and text, so an id that many rows have, or null for all of them, is
    sampled like any others, and a row that is repeated counts once.
    """
    fit_rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    turn = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    turns = fit_rows.select(F.col("lang").alias("_lang"), turn.alias("_turn"))
    # hashes are even: a threshold leaves about twice the bound of a language to rank, if it has as
    # many; one row per language, as many as the model has columns
    share = F.least(F.lit(1.0), (2.0 * per_language + 100) / F.approx_count_distinct("_turn"))
    limit = turns.groupBy("_lang").agg((share * 2.0**64 - 2.0**63).alias("_limit"))
    near = turns.join(F.broadcast(limit), "_lang").filter(F.col("_turn") <= F.col("_limit")).select("_lang", "_turn").distinct()
    first = Window.partitionBy("_lang").orderBy("_turn")
    cut = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_language)
    # broadcast, so that of texts only the sample's are shuffled
    last = cut.groupBy("_lang").agg(F.max("_turn").alias("_last"))
    joined = fit_rows.select("lang", "text", turn.alias("_turn")).join(F.broadcast(last), F.col("lang") == F.col("_lang"))
    return joined.filter(F.col("_turn") <= F.col("_last")).dropDuplicates(["lang", "_turn"]).select("lang", "text")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    count: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            count.update((lang, w) for w in stretches(words_of(text.as_py())))
    keys = list(count)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, vocabulary: str | None = None, rounds: int = ROUNDS) -> Model | None:
    ship_package(docs.sparkSession)
    counted = sample(docs, per_language).mapInArrow(_word_counts, "lang string, word string, n long")
    # bounded: the words of per_language documents for each language
    rows = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    if rows.empty:
        return None
    languages, words = sorted(rows["lang"].unique()), sorted(rows["word"].unique())
    chosen = pieces(vocabulary)
    n = np.zeros((len(words), len(languages)))
    n[np.searchsorted(words, rows["word"]), np.searchsorted(languages, rows["lang"])] = rows["n"]
    size = len(chosen) + 1
    model = Model(list(languages), chosen, np.full((size, len(languages)), 1.0 / size), np.full(len(languages), -np.log(len(languages))))
    graphs = [(at, codes.shape[1], model.lattice.arcs(codes)) for at, codes in _by_length(words)]
    for k in range(rounds):
        model.probability = _expected(model, graphs, n, longer=k == 0)
    return model


def _expected(model: Model, graphs: list, n: np.ndarray, longer: bool) -> np.ndarray:
    """Piece probabilities from their expected counts over all segmentations."""
    size, langs = model.probability.shape
    table = np.vstack([model.probability, np.zeros(langs)])
    if longer:  # flat at first: one factor per character, so that no length is preferred
        lengths = np.array([len(p) for p in model.vocabulary] + [1, 1])
        table = np.repeat(0.05 ** lengths[:, None], langs, axis=1)
        table[-1] = 0.0
        table[-2] = 0.05 * 0.01
    # a factor for each character is in all of a word's segmentations, so that shares are as they
    # were; it keeps words of rare characters from underflow
    table *= 1e3 ** np.array([len(p) for p in model.vocabulary] + [1, 0])[:, None]
    count = np.zeros((size + 1, langs))
    for at, length, arcs in graphs:
        forward, backward = np.zeros((length + 1, len(at), langs)), np.zeros((length + 1, len(at), langs))
        forward[0], backward[length] = 1.0, 1.0
        for start, end, number in arcs:
            forward[end] += forward[start] * table[number]
        for start, end, number in reversed(arcs):
            backward[start] += backward[end] * table[number]
        known = forward[length] > TINY
        weight = np.divide(n[at], forward[length], out=np.zeros_like(forward[length]), where=known)
        for start, end, number in arcs:
            share = forward[start] * table[number] * backward[end] * weight
            for lang in range(langs):
                count[:, lang] += np.bincount(number % (size + 1), share[:, lang], size + 1)
        rest = np.where(known, 0.0, n[at])
        if (some := np.flatnonzero(rest.any(axis=1))).size:
            _add_in_logs(count, table, [(start, end, number[some]) for start, end, number in arcs], length, rest[some])
    count = count[:size] + SMOOTHING
    return count / count.sum(axis=0)


def _add_in_logs(count: np.ndarray, table: np.ndarray, arcs: list, length: int, n: np.ndarray) -> None:
    """Add the expected counts of words whose likelihood no double holds."""
    with np.errstate(divide="ignore"):
        log = np.log(table)
    forward, backward = np.full((2, length + 1, *n.shape), -np.inf)
    forward[0], backward[length] = 0.0, 0.0
    for start, end, number in arcs:
        forward[end] = np.logaddexp(forward[end], forward[start] + log[number])
    for start, end, number in reversed(arcs):
        backward[start] = np.logaddexp(backward[start], backward[end] + log[number])
    for start, end, number in arcs:
        share = np.exp(forward[start] + log[number] + backward[end] - forward[length]) * n
        for lang in range(n.shape[1]):
            count[:, lang] += np.bincount(number % len(count), share[:, lang], len(count))


# -- prediction -------------------------------------------------------------------------------
ADDED = ("lang_pred", "score")


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the posterior of the predicted language)."""
    spark = docs.sparkSession
    if model is None:
        return docs.drop(*ADDED).withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # bounded: vocabulary times languages
    at_column = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if c not in ADDED]
    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    docs_columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        langs = len(model.languages)
        memo: dict[str, int] = {}
        known, chars = np.zeros((0, langs)), 0
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                if len(memo) > MEMO or chars > 16 * MEMO:
                    memo, known, chars = {}, np.zeros((0, langs)), 0
                ids: list[int] = []
                lengths, letters = [], []
                for value in batch.column(at_column):
                    t = value.as_py() or ""
                    words = words_of(t)
                    letters.append(any(map(str.isalpha, t)))
                    lengths.append(len(words))
                    ids += [memo.setdefault(w, len(memo)) for w in words]
                fresh = list(memo)[len(known) :]
                if fresh:
                    chars += sum(map(len, fresh))
                    known = np.concatenate([known, model.words(fresh)])
                total = np.tile(model.prior, (batch.num_rows, 1))
                length = np.array(lengths)
                full = np.flatnonzero(length)
                if len(full):
                    starts = np.cumsum(length[full]) - length[full]
                    total[full] += np.add.reduceat(known[np.array(ids)], starts, axis=0)
                best = total.argmax(axis=1)
                posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in kept), pa.array(names, pa.string()), pa.array(np.where(letters, posterior, 0.0), pa.float64())],
                    names=[*(docs_columns[i] for i in kept), *ADDED],
                )

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Rows of op8."""
    model = fit(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")), model).select("doc_id", "held_out", "lang_pred", "score")
