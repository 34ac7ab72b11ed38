"""Quality rules by weak supervision, in DataFrame expressions alone.

Each rule looks at one measure of a text and votes good (+1), bad (-1) or abstains (0).  The
votes of all documents are counted by pattern (at most 3 to the number of rules rows, however
many documents there are), expectation-maximisation over those counts estimates how often each
rule votes which way on good and on bad documents, and a document is kept if its posterior
probability of being good is at least ``KEEP``.  Base failures are a hard rule beside that.

Everything per document is computed in its own row (no shuffle of texts): repeated 3-word
windows are found by sorting the row's own window hashes.

Defined results: a null or empty text has no words and fails the base; repeated rows and rows
that share a doc_id are judged each on its own; a very long text is measured whole, in its row; an
empty table gives none; other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A word with a symbol, and one of letters with marks behind it, from blank to blank; counted in
#: one pass over a text rather than word by word.
SYMBOL_WORD = r"[^\x20\x09-\x0D#*$%&|<>]*+[#*$%&|<>][^\x20\x09-\x0D]*+"
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?]*+(?![^\x20\x09-\x0D])"
WINDOW, MIN_WORDS, MAX_REPEAT = 3, 50, 50
KEEP, ROUNDS, PRIOR_GOOD = 0.5, 60, 0.8


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on, good up to ``good``, and abstains between and on no measure."""

    name: str
    measure: str
    good: float
    bad: float

    def vote(self) -> Column:
        x, sign = F.expr(self.measure), 1 if self.bad > self.good else -1
        return F.when(sign * x >= sign * self.bad, -1).when(sign * x <= sign * self.good, 1).otherwise(0).cast("int")


#: Measures over the columns of ``measured``; shares of nothing are null, and null abstains.
RULES = (
    Rule("long_enough", "n_words", 80, 30),
    Rule("plain_symbols", "try_divide(n_symbols, word_chars)", 0.01, 0.04),
    Rule("symbols_apart", "try_divide(n_symbol_words, n_words)", 0.03, 0.2),
    Rule("plain_words", "try_divide(n_plain_words, n_words)", 0.8, 0.55),
    Rule("lines_differ", "try_divide(n_dup_lines, n_lines)", 0.15, 0.4),
    Rule("windows_differ", "try_divide(n_repeat_words, n_words)", 0.2, 0.45),
    Rule("words_differ", "try_divide(n_distinct_words, n_words)", 0.25, 0.08),
    Rule("small_letters", "try_divide(n_upper, word_chars)", 0.2, 0.5),
    Rule("calm", "try_divide(n_shouts, n_words)", 0.02, 0.2),
    Rule("sentences", "try_divide(n_stops, n_words)", 0.02, 0.004),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of three which the text has twice or more."""

    def covered(windows: Column) -> Column:
        n = F.size(windows)

        def same(a: Column, b: Column) -> Column:
            return F.get(windows, a)["h"] == F.get(windows, b)["h"]

        twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        places = F.flatten(F.transform(twice, lambda k: F.sequence(F.get(windows, k)["i"], F.get(windows, k)["i"] + WINDOW - 1)))
        return F.size(F.array_distinct(places))

    def numbered(hashes: Column) -> Column:
        # most texts repeat no window, which a set of the hashes shows more cheaply than sorting
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ordered, covered))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return _let(F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), numbered)

    return F.when(F.size(words) < WINDOW, 0).otherwise(windows(words)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, measures): counts of each row's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    lines = F.split(text, "\n", -1)

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        )

    with_words = _let(lines, lambda all_: F.filter(all_, lambda line: F.trim(line, F.lit(BLANKS)) != ""))
    length = F.char_length(text)
    found = docs.select(
        "doc_id",
        _let(words, counts).alias("w"),
        _let(with_words, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.size(F.array_distinct(ls)).cast("long").alias("d"))).alias("l"),
        F.regexp_count(text, F.lit(SYMBOL_WORD)).cast("long").alias("n_symbol_words"),
        F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long").alias("n_plain_words"),
        _without(text, BLANKS).cast("long").alias("word_chars"),
        (length - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (length - _without(text, "!")).cast("long").alias("n_shouts"),
        (length - _without(text, ".!?")).cast("long").alias("n_stops"),
    )
    return found.select("doc_id", "w.*", F.col("l.n").alias("n_lines"), (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), "n_symbol_words", "n_plain_words", "word_chars", "n_symbols", "n_upper", "n_shouts", "n_stops")


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good before any vote, and what each rule's vote adds, by EM over patterns."""
    rules = len(patterns[0][0]) if patterns else 0
    if not rules:
        return 0.0, []
    # at first two bad votes make a document bad: kinds of junk differ, so each fails few rules
    good = [1 / (1 + math.exp(3.0 * p.count(-1) - 4.5)) for p, _ in patterns]
    prior, odds = 0.0, []
    for _ in range(rounds):
        yes = sum(g * n for g, (_, n) in zip(good, patterns))
        no = sum((1 - g) * n for g, (_, n) in zip(good, patterns))
        # pseudo-counts: a rule is taken to be right more often than wrong
        prior = math.log((yes + 10 * PRIOR_GOOD) / (no + 10 * (1 - PRIOR_GOOD)))
        odds = []
        for r in range(rules):
            of = {v: [1.0 + 4 * (v > 0), 1.0 + 4 * (v < 0)] for v in (-1, 0, 1)}
            for g, (p, n) in zip(good, patterns):
                of[p[r]][0] += g * n
                of[p[r]][1] += (1 - g) * n
            sums = [sum(x[c] for x in of.values()) for c in (0, 1)]
            odds.append({v: math.log(a / sums[0]) - math.log(b / sums[1]) for v, (a, b) in of.items()})
        good = [1 / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(odds[r][v] for r, v in enumerate(p)))))) for p, _ in patterns]
    return prior, odds


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, measures, votes, posterior, base_failed, kept) of each row of ``docs``."""
    voted = measured(docs).select("*", F.array(*[r.vote() for r in rules]).alias("votes"))
    voted = written(voted, "quality")
    # bounded: at most 3 ** len(rules) patterns
    patterns = [(tuple(r.votes), r["count"]) for r in voted.groupBy("votes").count().collect()]
    prior, odds = fit(sorted(patterns))
    total = F.lit(prior)
    for k, by_vote in enumerate(odds):
        vote = F.get("votes", F.lit(k))
        total = total + F.when(vote == -1, by_vote[-1]).when(vote == 1, by_vote[1]).otherwise(by_vote[0])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    scored = voted.withColumn("posterior", 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of op4."""
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))
