"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` is a store in the shared folder.  A batch of documents is reduced to a row per line
key: the number of documents that hold it and the largest of their ids.  The batch is merge-anti-joined with
the runs (sort-merge join on the key's 128-bit hash: both sides are dealt by it): keys that no run
has make the batch's own run, sorted by the hash, so each key stands in one run of the store; what
the batch says of keys met before is a table of gains beside the runs.  Runs of one level are
compacted, once there are ``fanout`` of them, into one sorted run of the next level, so a key is
rewritten as often as there are levels.  Counts are the runs' and the gains' together.

Two uses: ``LineRuns.novel`` (streaming: a batch keeps the lines no earlier batch had) and
``dedup`` (whole table: lines of at least ``min_chars`` found in ``min_docs`` documents go
everywhere but in the largest doc_id).

Defined results of ``dedup``: a null or empty text is one empty line, which is kept; a null
doc_id counts as one document, smaller than all others; rows that share a doc_id are one
document, and each of them is returned; very long texts are split in place, line by line, and what
they lose is listed by text, so that no list grows with the rows of one id; an empty table gives an
empty result; extra columns are carried through ``dedup``, whatever their names, and dropped by the
digest query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.rows import ROW, packed, unpacked
from tidemark.session import written

MIN_CHARS, MIN_DOCS = 20, 3
FANOUT, BATCHES = 3, 4
#: The characters stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case; other letters stay."""
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def key_hash(key: Column) -> list[Column]:
    """128 bits: two hashes of 64, of the key and of the key behind a fixed mark."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), F.lit(1), key).alias("h2")]


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, th, h1, h2) of each line that is long enough: ``doc`` never is null, ``th`` is the text's hash."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    long_keys = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    exploded = docs.select(_doc(docs).alias("doc"), F.xxhash64("text").alias("th"), F.explode(F.array_distinct(long_keys)).alias("key"))
    return exploded.select("doc", "th", *key_hash(F.col("key")))


def _doc(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, max_doc) in the shared folder, and gains of their keys."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.gains: list[DataFrame] = []
        #: Merge-anti-joins and compactions so far.
        self.joins = self.compactions = 0

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc, h1, h2); a document may not be split over batches."""
        keys = lines.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))
        known = self._runs()
        if known:
            # one join tells both sides: without a partner is the anti-join, with one is a gain
            self.joins += 1
            met = reduce(DataFrame.unionByName, known).select("h1", "h2", F.lit(True).alias("met"))
            keys = written(keys.join(met.hint("merge"), ["h1", "h2"], "left").sortWithinPartitions("h1", "h2"), "line-batch")
            self.gains.append(keys.filter("met").drop("met"))
            self._put(keys.filter("met is null").drop("met"), 0)
        else:
            # the aggregation has dealt the rows by hash already: sorting needs no other shuffle
            self._put(written(keys.sortWithinPartitions("h1", "h2"), "line-run"), 0)

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self.compactions += 1
            full, self.levels[level] = self.levels[level], []
            both = reduce(DataFrame.unionByName, full)
            self._put(written(both.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "line-run"), level + 1)

    def merged(self) -> DataFrame | None:
        """(h1, h2, n_docs, max_doc) of every key."""
        tables = self._runs() + self.gains
        if not tables:
            return None
        return reduce(DataFrame.unionByName, tables).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def novel(self, lines: DataFrame) -> DataFrame:
        """Merge-anti-join: the rows of ``lines`` whose key is in no run."""
        for run in self._runs():
            lines = lines.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return lines


def runs_of(lines: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> LineRuns:
    """The store after ``lines`` (doc, h1, h2) have gone through it in batches of documents."""
    runs = LineRuns(lines.sparkSession, fanout)
    for k in range(batches):
        runs.add(lines.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k))
    return runs


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, th, dropped: array of h1) of the texts that lose lines.

    128 bits tell keys apart over the corpus; within one document 64 of them are enough.
    """
    lines = written(document_lines(docs, min_chars), "lines")
    # written, so that both sides of the join are plain exchanges and a hot line can be split
    frequent = written(runs_of(lines, batches, fanout).merged().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc"), "line-frequent")
    lost = lines.join(frequent, ["h1", "h2"]).filter(F.col("doc") != F.col("max_doc"))
    return lost.groupBy("doc", "th").agg(F.collect_set("h1").alias("dropped"))


def kept_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(``_row``: the row of ``docs``, kept_text, n_lines, n_dropped)."""
    lost = repeated(docs, min_chars, min_docs, batches)

    def stays(line: Column) -> Column:
        key = line_key(line)
        return F.col("_dropped").isNull() | (F.char_length(key) < min_chars) | ~F.array_contains(F.col("_dropped"), key_hash(key)[0])

    carried = packed(docs, _doc=_doc(docs), _th=F.xxhash64(docs["text"]))
    joined = carried.join(lost.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("dropped").alias("_dropped")), ["_doc", "_th"], "left")
    # split after the join: the text is dealt out once, in its row
    lined = joined.withColumn("_lines", F.split(F.coalesce(F.col(ROW)["text"], F.lit("")), "\n", -1))
    kept = lined.withColumn("_kept", F.filter("_lines", stays))
    return kept.select(ROW, F.array_join("_kept", "\n").alias("kept_text"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"))


ADDED = ("kept_text", "n_lines", "n_dropped")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped; they take the place of columns so named."""
    found = kept_lines(docs, min_chars, min_docs, batches)
    return found.select(*unpacked(found, [c for c in docs.columns if c not in ADDED]), *ADDED)


def digest(docs: DataFrame) -> DataFrame:
    """Rows of op2."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, ordinality AS pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ordinality
        FROM documents)
), keys AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (k.key IS NOT NULL AND l.doc_id <> k.top) AS gone
  FROM lines l LEFT JOIN keys k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
