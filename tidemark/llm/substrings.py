"""Suffix-array dedup by prefix-free parsing: bytes in a long string that occurs twice.

*Triggers.*  A rolling hash over ``TRIGGER`` bytes is taken at each place of a text.  The trigger of
a window of ``PASSAGE`` bytes is the place of the least hash in it (of equal ones the first), so it
depends on the window's bytes alone, exists in any text, and equal windows have equal triggers at
one offset.

*Phrases.*  The consecutive windows that one trigger place governs make a phrase: the bytes from
the first of them up to the trigger are the dictionary's side, and what follows from the trigger on,
up to ``LENGTH`` bytes behind the last window's start, is a suffix of the parse.  Each window is in one phrase, a
phrase has under ``PASSAGE + LENGTH`` bytes, and a stretch that repeats itself (a long run of one
letter) is one row with a number of repetitions.  Triggers that govern one phrase of the corpus
cannot repeat and drop out; of the rest, equal phrases are one entry with a count.

*Suffix arrays.*  The entries of a trigger meet in a shard.  Two arrays are sorted there: the
dictionary's sides by their suffixes (bytes read backwards from the trigger), and the suffixes of
the parse, each with the lengths of the prefixes that neighbours share.

*Combination.*  A window starts ``x`` bytes before its trigger.  Ordered by (x, the dictionary's suffix of
x bytes, rank in the parse), windows are in corpus order, and a window's longest match elsewhere
is x and the least shared prefix on the way to the next window with that dictionary suffix.  A
match of ``LENGTH`` bytes is removed; one of ``PASSAGE`` bytes and more is told as a shared passage.
A trigger with over ``HOT`` entries is spread over several shards, which hand on one hash for each
distinct window; what two shards hand on is repeated too.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows that share a
doc_id are texts of their own, and equal rows are copies of each other; null doc_ids are allowed;
very long texts are parsed in blocks; an empty table gives none; extra columns, whatever their
names, don't matter (the columns named in ``dedup`` are all that is returned).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package, written

#: Bytes of a string that is removed, of a shared passage that is told, and under the rolling hash.
LENGTH, PASSAGE, TRIGGER = 400, 256, 64
#: Whole words in a shared passage that make a document one that repeats a passage.
WORDS = 50
HOT = 4096
#: Bytes of text hashed at once, and of a shard's entries ordered at once (a trigger's entries
#: stay together: HOT of under PASSAGE + LENGTH bytes at most).
CHUNK, SHARD = 1 << 20, 1 << 21
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_PLACE = np.uint64(31)


# -- parse ------------------------------------------------------------------------------------
def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed polynomial hash of the ``width`` bytes (a power of two) at each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    power, size = _BASE, 1
    while size < width:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & _MASK, size * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def phrases(pieces: list[bytes], windows: list[int], length: int = LENGTH, passage: int = PASSAGE, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, trigger's offset, trigger's hash, repetitions) of each phrase.

    ``windows`` says how many windows start in each piece.
    """
    sizes = np.array([len(t) for t in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    starts = np.cumsum(sizes) - sizes
    h = rolling(data, trigger)
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_least(h >> _PLACE << _PLACE | place, passage - trigger + 1) & np.uint64((1 << 31) - 1)
    least = least.astype(np.int64)
    number = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    valid = np.arange(len(least)) - starts[number] < np.array(windows)[number]
    change = np.r_[True, (least[1:] != least[:-1]) | (number[1:] != number[:-1])]
    first = np.flatnonzero(valid & (change | np.r_[True, ~valid[:-1]]))
    last = np.flatnonzero(valid & np.r_[change[1:] | ~valid[1:], True])
    of, width, offset = number[first], last - first + 1, least[first] - first
    value = h[least[first]]
    end = np.minimum(last + length, (starts + sizes)[of])
    again = _again(data, of, first, width, offset, value, end)
    keep = np.flatnonzero(~np.r_[False, again[:-1]])
    repetitions = np.diff(np.r_[keep, len(first)])
    return of[keep], (first - starts[of])[keep], width[keep], offset[keep], value[keep], repetitions


def _again(data: np.ndarray, of: np.ndarray, first: np.ndarray, width: np.ndarray, offset: np.ndarray, value: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which phrases are followed by an equal one."""
    again = np.zeros(len(first), bool)
    alike = [x[1:] == x[:-1] for x in (of, width, offset, value, end - first)] + [first[1:] == first[:-1] + width[:-1]]
    at = np.flatnonzero(np.logical_and.reduce(alike))
    if not len(at):
        return again
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    for stretch in np.split(at, cut):
        a, z, q = first[stretch[0]], end[stretch[-1] + 1], width[stretch[0]]
        wrong = np.r_[0, np.cumsum(data[a : z - q] != data[a + q : z])]
        again[stretch] = wrong[end[stretch] - a] == wrong[first[stretch] - a]
    return again


_PARSE = {"d": pa.int64(), "th": pa.int64(), "mh": pa.int64(), "r1": pa.int64(), "r2": pa.int64(), "s": pa.int32(), "width": pa.int32(), "at": pa.int32(), "times": pa.int32()}
_PARSE_SCHEMA = "d long, th long, mh long, r1 long, r2 long, s int, width int, at int, times int"


def _parse(length: int, passage: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, windows, rows, bases, size = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                of, s, width, at, value, times = phrases(pieces, windows, length, passage, trigger)
                digest = xxhash.xxh3_128_digest
                raw = b"".join([digest(pieces[k][a : a + w - 1 + length], w) for k, a, w in zip(of.tolist(), s.tolist(), width.tolist())])
                r = np.frombuffer(raw, "<i8").reshape(-1, 2) if raw else np.zeros((0, 2), np.int64)
                row = pa.array(np.array(rows, np.int64)[of])
                own = [np.ascontiguousarray(r[:, 0]), np.ascontiguousarray(r[:, 1]), s + np.array(bases, np.int64)[of], width, at, times]
                columns = [batch.column(0).take(row), batch.column(1).take(row), pa.array(value.view(np.int64)), *map(pa.array, own)]
                return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _PARSE.values())], list(_PARSE))

            for i, value in enumerate(batch.column(2)):
                raw = value.as_py()
                count = 0 if raw is None else len(raw) - passage + 1
                for base in range(0, count, CHUNK):
                    here = min(CHUNK, count - base)
                    pieces.append(raw[base : base + here - 1 + length])
                    windows.append(here)
                    rows.append(i)
                    bases.append(base)
                    size += len(pieces[-1])
                    if size >= CHUNK:
                        yield out()
                        pieces, windows, rows, bases, size = [], [], [], [], 0
            if pieces:
                yield out()

    return run


# -- suffix arrays ----------------------------------------------------------------------------
def suffix_array(strings: list[bytes], group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by group and bytes, bytes each shares with the one before it; -1: of another group)."""
    size = np.array([len(x) for x in strings], np.int64)
    table = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in strings]), np.uint8).reshape(len(strings), width)
    order = np.argsort(size, kind="stable")  # of texts that differ in zero bytes at their ends, the shorter first
    order = order[np.argsort(table.view(f"S{width}").ravel()[order], kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    shared = np.full(len(strings), -1, np.int64)
    a, b = order[:-1], order[1:]
    differ = table[a] != table[b]
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    shared[1:] = np.where(group[a] == group[b], np.minimum(found, np.minimum(size[a], size[b])), -1)
    return order, shared


class Least:
    """The least of ``values[low + 1 : high + 1]`` for many pairs at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while step * 2 <= len(values):
            now = self.levels[-1]
            self.levels.append(np.r_[np.minimum(now[:-step], now[step:]), now[len(now) - step :]])
            step *= 2
        self.table = np.stack(self.levels)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low + 1], self.table[level, high + 1 - (1 << level)])


def matches(group: np.ndarray, bodies: list[bytes], at: np.ndarray, width: np.ndarray, length: int = LENGTH, passage: int = PASSAGE, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """(entry, first byte, longest match with the window before, and with that after it) of windows in corpus order."""
    reach = passage - trigger
    sides = [b[:k][::-1] for b, k in zip(bodies, at.tolist())]
    order, shared = suffix_array(sides, group, max(reach, 1))
    # the dictionary's suffix of x bytes, named by the first of those that share it
    depth = np.arange(reach + 1)
    names = np.maximum.accumulate(np.where(shared[:, None] < depth[None, :], np.arange(len(order))[:, None], 0), axis=0)
    name = np.empty_like(names)
    name[order] = names
    order, shared = suffix_array([b[k:] for b, k in zip(bodies, at.tolist())], group, length)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entry, x = np.nonzero((depth <= at[:, None]) & (depth > (at - width)[:, None]))
    key = (x << 44) | (name[entry, x] << 22) | rank[entry]
    key, by = np.sort(key), np.argsort(key)
    entry, x = entry[by], x[by]
    common = np.zeros(len(key), np.int64)
    same = np.flatnonzero(key[1:] >> 22 == key[:-1] >> 22)
    low, high = rank[entry[same]], rank[entry[same + 1]]
    common[same + 1] = x[same + 1] + Least(shared)(low, high)
    return entry, at[entry] - x, common, np.r_[common[1:], 0]


def _runs(entry: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """(entry, first, last) of runs of windows."""
    if not len(entry):
        return []
    by = np.lexsort((place, entry))
    entry, place = entry[by], place[by]
    cut = np.r_[True, (np.diff(place) != 1) | (np.diff(entry) != 0)]
    return list(zip(entry[cut].tolist(), place[cut].tolist(), place[np.r_[cut[1:], True]].tolist()))


_RANGE = pa.list_(pa.struct([("deep", pa.bool_()), ("a", pa.int32()), ("b", pa.int32())]))
_WINDOW = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("deep", pa.bool_()), ("a", pa.int32())]))
_SHARD_SCHEMA = "mh long, r1 long, r2 long, ranges array<struct<deep:boolean,a:int,b:int>>, windows array<struct<h1:long,h2:long,deep:boolean,a:int>>"


def _shard(length: int, passage: int, trigger: int):
    def process(rows: list[tuple]) -> pa.RecordBatch:
        bodies = [r[7] for r in rows]
        mh = np.array([r[:2] for r in rows], np.int64)
        group = np.r_[0, np.cumsum((mh[1:] != mh[:-1]).any(axis=1))]
        entry, place, before, after = matches(group, bodies, np.array([r[6] for r in rows]), np.array([r[5] for r in rows]), length, passage, trigger)
        ranges: list[list] = [[] for _ in rows]
        windows: list[list] = [[] for _ in rows]
        spread = np.array([r[2] for r in rows], bool)[entry]
        size = np.array([len(b) for b in bodies])[entry]
        for deep, least in ((False, passage), (True, length)):
            hit = (before >= least) | (after >= least)
            for k, a, b in _runs(entry[hit], place[hit]):
                ranges[k].append({"deep": deep, "a": a, "b": b})
            for i in np.flatnonzero(spread & (before < least) & (place + least <= size)).tolist():
                k, a = int(entry[i]), int(place[i])
                h1, h2 = np.frombuffer(xxhash.xxh3_128_digest(bodies[k][a : a + least]), "<i8").tolist()
                windows[k].append({"h1": h1, "h2": h2, "deep": deep, "a": a})
        keep = [k for k in range(len(rows)) if ranges[k] or windows[k]]
        return pa.RecordBatch.from_arrays(
            [*[pa.array([rows[k][c] for k in keep], pa.int64()) for c in (0, 3, 4)], pa.array([ranges[k] for k in keep], _RANGE), pa.array([windows[k] for k in keep], _WINDOW)],
            ["mh", "r1", "r2", "ranges", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups, and the one that goes on
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if held and row[:5] == held[-1][:5]:
                    continue  # the same entry from a repeated row
                if row[:2] != last and size >= SHARD:
                    yield process(held)
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[7])
        if held:
            yield process(held)

    return run


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["d"].eqNullSafe(right["d"]) & (left["th"] == right["th"])


def repeated_windows(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """(d, th, found): for each text with repeated windows, its phrases' places and ranges of window starts."""
    if not trigger <= passage <= length:
        raise ValueError("a trigger must fit into a passage, and a passage into what is removed")
    spark = docs.sparkSession
    ship_package(spark)
    texts = keyed(docs)
    parse = written(texts.mapInArrow(_parse(length, passage, trigger), _PARSE_SCHEMA), "substring-parse")
    # written, so that both sides of the join are plain exchanges and a hot trigger can be split
    lively = written(parse.groupBy("mh").agg(F.sum("times").alias("n")).filter("n > 1").select("mh"), "substring-lively")
    live = written(parse.join(lively, "mh", "left_semi"), "substring-live")
    first = F.min(F.struct("d", "th", "s", "width", "at")).alias("at")
    entries = written(live.groupBy("mh", "r1", "r2").agg(F.sum("times").alias("n"), first), "substring-entries")
    per_trigger = written(entries.groupBy("mh").agg(F.count(F.lit(1)).alias("different")).filter("different > 1"), "substring-triggers")
    spread = F.col("different") > hot
    sub = F.when(spread, F.pmod("r1", F.ceil(F.col("different") / hot))).otherwise(F.lit(0)).cast("long")
    own = F.struct("mh", sub.alias("sub"), spread.alias("spread"), "r1", "r2", F.col("at.s").alias("s"), F.col("at.width").alias("width"), F.col("at.at").alias("at"))
    looked = entries.join(per_trigger, "mh").select(F.col("at.d").alias("d"), F.col("at.th").alias("th"), own.alias("x"))
    wanted = looked.groupBy("d", "th").agg(F.collect_list("x").alias("xs"))
    body = F.transform("xs", lambda x: F.struct(*[x[c] for c in ("mh", "sub", "spread", "r1", "r2", "width", "at")], F.substring(F.col("raw"), x["s"] + 1, x["width"] - 1 + length).alias("body")))
    cut = texts.join(wanted, same_row(texts, wanted)).select(F.explode(body).alias("x")).select("x.*").toDF("mh", "sub", "spread", "r1", "r2", "width", "at", "body")
    sharded = cut.repartition("mh", "sub").sortWithinPartitions("mh", "sub", "r1", "r2")
    ranked = written(sharded.mapInArrow(_shard(length, passage, trigger), _SHARD_SCHEMA), "substring-ranked")
    met = ranked.select("mh", "r1", "r2", F.explode("windows").alias("w")).select("mh", "r1", "r2", "w.*")
    hashes = ["h1", "h2", "deep"]
    again = met.join(met.groupBy(hashes).agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), hashes, "left_semi")
    ends = [F.lit(0).alias("a"), (F.col("at.width") - 1).alias("b")]
    whole = entries.filter("n > 1").select("mh", "r1", "r2", F.explode(F.array(*[F.struct(F.lit(deep).alias("deep"), *ends) for deep in (False, True)])).alias("r"))
    parts = ranked.select("mh", "r1", "r2", F.explode("ranges").alias("r"))
    across = again.select("mh", "r1", "r2", F.struct("deep", "a", F.col("a").alias("b")).alias("r"))
    ranges = whole.union(parts).union(across).groupBy("mh", "r1", "r2").agg(F.collect_set("r").alias("ranges"))
    # as above
    ranges = written(ranges, "substring-ranges")
    found = live.join(ranges, ["mh", "r1", "r2"])
    # a set: rows that share id and text have the same phrases
    return found.groupBy("d", "th").agg(F.collect_set(F.struct("s", "width", "times", "ranges")).alias("found"))


def keyed(docs: DataFrame) -> DataFrame:
    """(d, th, raw): a text's row key (its id and hash) and its bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("th"), text.cast("binary").alias("raw"))


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    spans: list[list[int]] = []
    for a, b in sorted(ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    return spans


def whole_words(raw: bytes, a: int, b: int) -> int:
    """Words of ``raw`` that lie in a..b from end to end."""
    found = len(raw[a:b].split())
    blank = b" \t\n\x0b\x0c\r"
    cut_left = a > 0 and raw[a - 1] not in blank and raw[a] not in blank
    cut_right = b < len(raw) and raw[b - 1] not in blank and raw[b] not in blank
    return max(0, found - cut_left - cut_right)


def _apply(length: int, passage: int):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                all_spans, kept, size, words = [], [], [], []
                for raw, found in zip(batch.column(1), batch.column(2)):
                    raw, found = raw.as_py(), found.as_py()
                    starts: dict[bool, list[tuple[int, int]]] = {False: [], True: []}
                    for x in found or ():
                        for r in x["ranges"]:
                            least = length if r["deep"] else passage
                            a, b = (x["s"] + r["a"], x["s"] + r["b"]) if x["times"] == 1 else (x["s"], x["s"] + x["width"] * x["times"] - 1)
                            b = min(b, len(raw) - least)
                            if a <= b:
                                starts[r["deep"]].append((a, b + least))
                    spans = merged(starts[True])
                    rest, done = [], 0
                    for a, b in spans:
                        rest.append(raw[done:a])
                        done = b
                    rest.append(raw[done:])
                    all_spans.append([{"start": a, "end": b} for a, b in spans])
                    kept.append(b"".join(rest))
                    size.append(len(raw))
                    words.append(max((whole_words(raw, a, b) for a, b in merged(starts[False])), default=0))
                columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(all_spans, spans_type), pa.array(kept, pa.binary()), pa.array(words, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept", "passage_words"])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans removed, kept bytes, passage_words) of each row of ``docs``.

    ``passage_words``: the most whole words in one stretch that matches of ``passage`` bytes and
    more cover, whether or not it is long enough to be removed.
    """
    found = written(repeated_windows(docs, length, passage, trigger, hot), "substring-found")
    texts = keyed(docs)
    joined = texts.join(found, same_row(texts, found), "left").select(texts["d"].alias("doc_id"), "raw", "found")
    return joined.mapInArrow(_apply(length, passage), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, passage_words long")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of op1; ``repeats_passage`` also tells shared passages that are too short to be removed."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + (x["end"] - x["start"]))
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "passage_words",
        (F.col("passage_words") >= WORDS).alias("repeats_passage"),
    )
