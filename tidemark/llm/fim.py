"""Fill-in-middle: texts cut at two token ranks that an indexable skip list finds.

*Units.*  A text is cut into tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``: a token
ends where white space follows a character that isn't, so the cuts are found on the UTF-8 bytes
of a whole text at once, and nothing is made per token but its width.

*Skip list.*  The bottom lane has a link per token; a token's tower is as high as a hash of its rank says,
a quarter of each lane standing in the next one.  A link carries how many tokens and how many code
points (and bytes) it spans.  A rank is found from the top lane down: links are taken while the tokens spanned so
far don't pass it; the widths added up on the way are the code point where it lies.

*Cuts.*  The first four groups of eight hex digits of sha256(``seed:doc_id``) give both ranks and the
form, so a document is cut alike wherever and however often it is read.

Defined results: a null text is the empty one and is plain; a null doc_id counts as the empty string in
the hash; a text that holds a marker stays plain, so that every output can be taken apart again; rows are
independent, so that ties and repeated rows don't matter; extra columns are carried, and one that has
the name of a column that is added gives way to it; an empty table gives none.  A task holds one
text and a few numbers per token of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of documents that are transformed, and of those the per cent with the suffix first.
RATE, SPM_RATE, SEED = 50, 80, 42
#: One token in so many of a lane stands in the lane above.
FAN = 4
#: Rows that go back to the JVM together.
ROWS = 512

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ADDED = [("n", T.LongType(), pa.int64()), ("form", T.StringType(), pa.string()), ("prefix_chars", T.LongType(), pa.int64()), ("middle_chars", T.LongType(), pa.int64()), ("output", T.StringType(), pa.string())]


def _towers(n: int) -> np.ndarray:
    """Height of each of n towers: geometric, by a hash of the rank, so that equal texts have equal lists."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    height = np.zeros(n, np.int64)
    left = np.ones(n, bool)
    while left.any():
        left &= x % np.uint64(FAN) == 0
        x //= np.uint64(FAN)
        height += left
        left &= x != 0
    return height


class SkipList:
    """Tokens of one text, found by rank; lanes are arrays of links, a link's widths stand beside it."""

    def __init__(self, raw: bytes):
        b = np.frombuffer(raw, np.uint8)
        white = _WHITE[b]
        ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1 if len(b) else np.zeros(0, np.int64)
        stops = np.r_[ends, len(b)] if len(b) else ends
        self.n = len(stops)
        first_bytes = ((b & 0xC0) != 0x80).view(np.uint8)
        reached = np.cumsum(np.add.reduceat(first_bytes, np.r_[0, ends], dtype=np.int64)) if len(b) else ends
        # the widest of all lanes first: (down: place in the lane below, tokens, code points, bytes of each link)
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        height = _towers(self.n)
        ranks = np.arange(1, self.n + 1)
        below = np.arange(0, self.n + 1)  # place of each stop, the head being 0
        for level in range(int(height.max(initial=0)) + 1 if self.n else 0):
            here = ranks[height >= level]
            at = stops[here - 1]
            chars = reached[here - 1]
            self.lanes.insert(0, (below[np.r_[0, here]], np.diff(here, prepend=0), np.diff(chars, prepend=0), np.diff(at, prepend=0)))
            below = np.zeros(self.n + 1, np.int64)
            below[here] = np.arange(1, len(here) + 1)
        #: Links taken by all searches.
        self.taken = 0

    def find(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) of the first ``rank`` tokens."""
        units = chars = size = place = 0
        for k, (down, tokens, points, widths) in enumerate(self.lanes):
            while place < len(tokens) and units + tokens[place] <= rank:
                units += int(tokens[place])
                chars += int(points[place])
                size += int(widths[place])
                place += 1
                self.taken += 1
            if k + 1 < len(self.lanes):
                place = int(down[place])
        if units != rank:
            raise ValueError(f"rank {rank} of {self.n}")
        return chars, size


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned numbers of a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def cut(raw: bytes, doc_id: int | None, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> tuple:
    """(tokens, form, code points of prefix, of middle, output) of one text; both widths are null if it is plain."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    tokens = SkipList(raw)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not raw or p in raw or s in raw or m in raw or h3 % 100 >= rate:
        return tokens.n, "plain", None, None, raw
    first, second = sorted((h1 % (tokens.n + 1), h2 % (tokens.n + 1)))
    (chars, a), (more, b) = tokens.find(first), tokens.find(second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    spm = h4 % 100 < spm_rate
    out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return tokens.n, "spm" if spm else "psm", chars, more - chars, out


def transformed(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with n, form, prefix_chars, middle_chars and output: one pass, no shuffle."""
    ship_package(docs.sparkSession)
    names = [name for name, _, _ in _ADDED]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    source = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept], F.col(text).cast("string").cast("binary").alias("_raw"), F.col(doc_id).cast("long").alias("_id"))
    width = len(kept)
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(n, kind) for n, kind, _ in _ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                made = [cut(raw or b"", i, rate, spm_rate, seed) for raw, i in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())]
                columns = list(zip(*made)) if made else [[]] * len(_ADDED)
                plain = [pa.array(v, kind) for v, (_, _, kind) in zip(columns[:-1], _ADDED)]
                output = pa.array(columns[-1], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *plain, output], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that was cut, from output and form alone."""
    out, kind = F.col(output), F.col(form)
    first = F.split(out, F.when(kind == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(2))
    head = F.substring(first[0], len(PREFIX) + 1, 2**31 - 1)
    then = F.split(first[1], F.lit(MIDDLE), F.lit(2))
    return F.when(kind == "plain", out).when(kind == "psm", F.concat(head, then[1], then[0])).otherwise(F.concat(then[0], then[1], head))


def digest(docs: DataFrame) -> DataFrame:
    """Digest rows of op11."""
    made = transformed(docs.select("doc_id", "text"), keep=["doc_id"])
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


#: Rows of op11; the text is rebuilt from output and form there too.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), units AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM docs
), ranks AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s
  FROM ranks
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts
), apart AS (
  SELECT *, output[4:] AS body, strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x, strpos(output, '<M>') AS y FROM made
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN output[4:x - 1] || output[y + 3:] || output[x + 3:y - 1]
         ELSE output[x + 3:y - 1] || output[y + 3:] || output[4:x - 1] END) AS restored_sha256
FROM apart
"""
