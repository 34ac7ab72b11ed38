"""BPE encoding and decoding of whole texts by tree concatenation.

*Tree.*  A text over ``leaf`` characters is halved until its parts are not, wherever the cuts fall;
the parts are encoded (in parallel where they are many), and joined pairwise upwards.

*Join.*  What two sides have next to their join may be wrong, so a window around it is encoded
again: it reaches at least ``k`` tokens into each side and from there on to the next place where the
splitting pattern always cuts, before a space or a line feed that follows a character which isn't
white space.  Both sides agree exactly if the window's first and last tokens are those that the sides
have there; if not, ``k`` is doubled.  A window that has grown over both sides is the plain
encoding.

*Unsplit text.*  A stretch of over ``UNSPLIT`` characters without such a place is taken apart by the
pattern itself, and a pre-token of over ``leaf`` bytes is a tree of its own, over bytes: a sequence of
tokens is the encoding of a pre-token exactly if every pair of neighbours is the encoding of its
own bytes, so there windows grow by tokens until the outermost ones agree.

Defined results: a null text is the empty text (no tokens); ``<|endoftext|>`` inside a text is
the special token, as the tokenizers library has it; a very long text is a deeper tree; rows are
independent, so ties and repeated rows don't matter; extra columns are carried, and one that has
the name of a column that is added gives way to it; an empty table gives none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship_package

#: Characters (bytes of a pre-token) in a leaf of the tree, characters of text without a certain
#: cut that the pattern takes apart, and leaves from which on they are encoded in parallel.
LEAF, UNSPLIT, PARALLEL = 1024, 8192, 16
#: Tokens on each side of a join that are encoded again at first, at least.
WINDOW = 16
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {chr(b): b for b in printable}
    for rank, b in enumerate(b for b in range(256) if b not in printable):
        table[chr(256 + rank)] = b
    return table


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str | None = None, leaf: int = LEAF, window: int = WINDOW):
        with open(path or default_vocabulary(), encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        for rank, merge in enumerate(spec["model"]["merges"]):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            if vocab["".join(pair)] != 256 + rank:
                raise ValueError("ids of merges must follow the merges' order")
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
        self._enc = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        # a special token, and what the pattern looks at behind a pre-token, must lie inside a window's side
        self.leaf, self.window = leaf, max(window, *(len(t.encode()) for t in special), 4)
        self._special = special
        self._split = regex.compile(PATTERN)
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special))) + ")") if special else None
        self._pool: ThreadPoolExecutor | None = None
        size = 1 + max([*ranks.values(), *special.values()])
        self._blank_first, self._ink_last = bytearray(size), bytearray(size)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self._blank_first[i] = token[:1] in (b" ", b"\n")
            last = token.decode("utf-8", errors="replace")[-1:]
            self._ink_last[i] = last != "\ufffd" and not last.isspace()
        #: Joins of texts and of pre-tokens so far.
        self.joins = self.byte_joins = 0

    # -- encoding -------------------------------------------------------------------------
    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        start = end = 0
        for piece in self.pieces(text):
            if len(piece) > UNSPLIT:
                ids += self._text_tree(text[start:end]) + self._unsplit(piece)
                start = end + len(piece)
            end += len(piece)
        return ids + self._text_tree(text[start:])

    def _plain(self, text: str) -> list[int]:
        return self._enc.encode(text, allowed_special="all")

    def _text_tree(self, text: str) -> list[int]:
        """Encode text with certain cuts: leaves, then joins upwards."""
        return self._tree(text, self._plain, self._join_texts) if text else []

    def _tree(self, whole, encode, join) -> list[int]:
        count = 1
        while len(whole) / count > self.leaf:
            count *= 2
        bounds = [len(whole) * i // count for i in range(count + 1)]
        each = map
        if count >= PARALLEL:
            self._pool = self._pool or ThreadPoolExecutor(2)
            each = self._pool.map
        level = list(each(encode, [whole[a:b] for a, b in zip(bounds, bounds[1:])]))
        while len(level) > 1:
            level = list(each(join, level[::2], level[1::2]))
        return level[0]

    def _join_texts(self, left: list[int], right: list[int]) -> list[int]:
        self.joins += 1
        k = self.window
        while True:
            a, b = max(0, len(left) - k), min(k, len(right))
            while a > 0 and not (self._blank_first[left[a]] and self._ink_last[left[a - 1]]):
                a -= 1
            while b < len(right) and not (self._blank_first[right[b]] and self._ink_last[right[b - 1]]):
                b += 1
            again = self._plain(self._enc.decode_bytes(left[a:] + right[:b]).decode("utf-8"))
            agreed_left = a == 0 or again[0] == left[a]
            agreed_right = b == len(right) or again[-1] == right[b - 1]
            if agreed_left and agreed_right:
                return left[:a] + again + right[b:]
            k *= 2

    def pieces(self, text: str) -> Iterator[str]:
        """Cut at places where the pattern always cuts; a piece over ``UNSPLIT`` has none inside."""
        start, n = 0, len(text)
        while n - start > UNSPLIT:
            at = self._cut_before(text, start + 1, start + UNSPLIT)
            if at < 0:
                at = self._cut_after(text, start + UNSPLIT + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        if start < n:
            yield text[start:]

    @staticmethod
    def _cut_before(text: str, low: int, high: int) -> int:
        at = high + 1
        while at > low:
            at = max(text.rfind(" ", low, at), text.rfind("\n", low, at))
            if at < 0:
                return -1
            if not text[at - 1].isspace():
                return at
        return -1

    @staticmethod
    def _cut_after(text: str, low: int) -> int:
        for m in regex.finditer(r"[ \n]", text, pos=low):
            if not text[m.start() - 1].isspace():
                return m.start()
        return -1

    def _unsplit(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self._special_split.split(text) if self._special_split else [text]:
            if part in self._special:
                ids.append(self._special[part])
                continue
            for token in self._split.findall(part):
                raw = token.encode("utf-8")
                ids += self._enc._encode_single_piece(raw) if len(raw) <= self.leaf else self.tree(raw)
        return ids

    def tree(self, raw: bytes) -> list[int]:
        """Encode bytes that the pattern doesn't split."""
        return self._tree(raw, self._enc._encode_single_piece, self._join)

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        self.byte_joins += 1
        k = self.window
        while True:
            a, b = left[max(0, len(left) - k) :], right[:k]
            again = self._enc._encode_single_piece(self._enc.decode_bytes(a + b))
            agreed_left = len(a) == len(left) or again[0] == a[0]
            agreed_right = len(b) == len(right) or again[-1] == b[-1]
            if agreed_left and agreed_right:
                return left[: len(left) - len(a)] + again + right[len(b) :]
            k *= 2

    # -- decoding -------------------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        return self._enc.decode_bytes(ids).decode("utf-8", errors="replace")


_CODECS: dict[tuple, Codec] = {}


def _codec(path: str | None, leaf: int, window: int) -> Codec:
    """One codec per Python worker: building its tables takes longer than many texts."""
    key = (path, leaf, window)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, leaf, window)
    return _CODECS[key]


#: Rows that go back to the JVM together.
ROWS = 512


def encode(
    df: DataFrame, text: str = "text", ids: str = "token_ids", vocabulary: str | None = None, leaf: int = LEAF, window: int = WINDOW, decoded: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all) of ``df`` and the token ids of ``text``; no shuffle, one Arrow pass.

    ``decoded`` names a column for the text of those ids, made in the same pass: a second one would
    take another Python worker per task.
    """
    ship_package(df.sparkSession)
    at = df.columns.index(text)
    kept = [c for c in (df.columns if keep is None else keep) if c not in (ids, decoded)]
    places = [df.columns.index(c) for c in kept]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    names = [*kept, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, leaf, window)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = [codec.encode(x.as_py()) for x in batch.column(at)]
                columns = [*(batch.column(p) for p in places), pa.array(found, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array(map(codec.decode, found), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *added]))


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with one more column: the text of the token ids (null ids: null)."""
    ship_package(df.sparkSession)
    at = df.columns.index(ids)
    kept = [i for i, c in enumerate(df.columns) if c != text]
    names = [*(df.columns[i] for i in kept), text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, LEAF, WINDOW)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                found = [None if (x := v.as_py()) is None else codec.decode(x) for v in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, pa.string())], names=names)

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digest rows of op10: each whole text encoded and decoded again."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    coded = encode(texts, vocabulary=vocabulary, decoded="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
