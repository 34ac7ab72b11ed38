"""Tab-separated events as a data source, in batch and as a stream, and a sink that takes every epoch once.

``spark.read.format("tidemark_events")`` cuts files into ranges of bytes, so a large file is many tasks: a line belongs to the range that it begins in.
Comparisons with literals are checked while lines are parsed.  A line that isn't an event doesn't fail the query but
comes as a row with its text and what is wrong with it; ``problem is null`` keeps the others.

``spark.readStream`` reads what files have grown by since the last micro-batch, up to their last line feed; an offset is the
length read of each file, so one that was read is known by its length alone.

``writeStream`` gives each epoch files of its own, sorted by (ts, seq) where there are such columns, nulls last.  Tasks write where nothing is read from; the
commit gives the files their names and then puts down a manifest with the digest of each.  An epoch that has a manifest and comes again
is dropped, so that no byte changes; ``committed`` reads what manifests name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from tidemark.model import APPROVED, DECLINED, EVENT_SCHEMA, FEATURE_COLUMNS
from tidemark.session import ship_package

NAME = "tidemark_events"
#: Bytes of a range, rows of a batch, rows that a writing task sorts at once.
RANGE, ROWS, RUN = 64 << 20, 4096, 50_000
_FIELDS = [f for f in EVENT_SCHEMA.fields if f.name in FEATURE_COLUMNS]
_NUMBERS = [i for i, f in enumerate(_FIELDS) if f.dataType == T.LongType()]
SCHEMA = T.StructType([*(T.StructField(f.name, f.dataType) for f in _FIELDS), T.StructField("problem", T.StringType()), T.StructField("line", T.StringType())])
_KINDS = [pa.int64() if f.dataType == T.LongType() else pa.string() for f in SCHEMA.fields]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path in its store, size) of a file, or of the files of a folder."""
    store, root = _store(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def parsed(line: str) -> tuple:
    """The fields of a line, why it isn't an event (or null), and then the line."""
    values = line.split("\t")
    if len(values) != len(_FIELDS):
        return (*[None] * len(_FIELDS), f"{len(values)} fields, not {len(_FIELDS)}", line)
    row: list = list(values)
    for i in _NUMBERS:
        try:
            row[i] = int(values[i])
        except ValueError:
            return (*[None] * len(_FIELDS), f"{_FIELDS[i].name} is no integer", line)
        if not -(2**63) <= row[i] < 2**63:
            return (*[None] * len(_FIELDS), f"{_FIELDS[i].name} is out of range", line)
    by = dict(zip(FEATURE_COLUMNS, row))
    why = None
    if by["status"] not in (APPROVED, DECLINED):
        why = "unknown status"
    elif by["amount_paise"] < 0:
        why = "amount is negative"
    else:
        why = next((f"{c} is empty" for c in ("merchant_id", "bin", "card_ref", "ip", "device_id") if not by[c]), None)
    return (*row, why, line if why else None)


@dataclass
class ByteRange(ds.InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def ranges(path: str, start: int, end: int, size: int) -> list[ByteRange]:
    return [ByteRange(path, a, min(end, a + size)) for a in range(start, end, size)]


def lines(store: fs.FileSystem, part: ByteRange) -> Iterator[str]:
    """The lines that begin in a range; one that ends behind it is read to its end."""
    with store.open_input_file(part.path) as file:
        at = max(part.start - 1, 0)
        file.seek(at)
        rest, skip = b"", part.start > 0
        while True:
            block = file.read(1 << 20)
            pieces = (rest + block).split(b"\n")
            rest = pieces.pop()
            for piece in pieces:
                begins, at = at, at + len(piece) + 1
                if skip:
                    skip = False
                    continue
                if begins >= part.end:
                    return
                yield piece.rstrip(b"\r").decode("utf-8", errors="replace")
            if not block:
                if rest and not skip and at < part.end:
                    yield rest.rstrip(b"\r").decode("utf-8", errors="replace")
                return


_TESTS = {
    ds.EqualTo: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.In: lambda a, b: a in b,
}


class _Lines:
    """Reading of ranges, for batch and stream."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("rangeBytes", RANGE))
        self.tests: list[tuple] = []

    def _wanted(self, row: tuple) -> bool:
        for at, kind, value in self.tests:
            if kind is ds.IsNull and row[at] is not None or kind is ds.IsNotNull and row[at] is None:
                return False
            if kind in _TESTS and (row[at] is None or not _TESTS[kind](row[at], value)):
                return False
        return True

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for line in lines(_store(self.path)[0], partition):
            if not line or line.startswith("#"):
                continue
            row = parsed(line)
            if self._wanted(row):
                held.append(row)
            if len(held) >= ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS)], names=SCHEMA.names)


class Reader(_Lines, ds.DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            at = SCHEMA.names.index(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 and f.attribute[0] in SCHEMA.names else None
            if at is None or type(f) not in (*_TESTS, ds.IsNull, ds.IsNotNull):
                yield f
            else:
                self.tests.append((at, type(f), getattr(f, "value", None)))

    def partitions(self):
        return [part for path, size in _files(self.path) for part in ranges(path, 0, size, self.size)]


class StreamReader(_Lines, ds.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: end for path, size in _files(self.path) if (end := self._whole_lines(path, size))}

    def _whole_lines(self, path: str, size: int) -> int:
        """Where the last line feed is behind; what comes after isn't a line yet."""
        with _store(self.path)[0].open_input_file(path) as file:
            while size > 0:
                begin = max(0, size - (1 << 16))
                file.seek(begin)
                found = file.read(size - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                size = begin
        return 0

    def partitions(self, start: dict, end: dict):
        return [part for path, to in sorted(end.items()) for part in ranges(path, start.get(path, 0), to, self.size)]

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(ds.WriterCommitMessage):
    file: str
    rows: int
    sha256: str


class EpochWriter(ds.DataSourceStreamWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns

    def _key(self, text: str):
        row = json.loads(text)
        return [(row[c] is None, row[c] or 0) for c in ("ts", "seq") if c in row], text

    def write(self, iterator) -> Written:
        """Sorted runs of bounded size, merged into one file; equal rows make equal bytes in any order."""
        store, root = _store(self.path)
        base = f"{root}/_pending/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/_pending")
        runs, held = [], []

        def spill() -> None:
            runs.append(f"{base}-{len(runs)}")
            with store.open_output_stream(runs[-1]) as out:
                out.write("".join(f"{x}\n" for x in sorted(held, key=self._key)).encode())
            held.clear()

        for row in iterator:
            held.append(json.dumps(row.asDict(recursive=True), sort_keys=True, ensure_ascii=False, default=str))
            if len(held) >= RUN:
                spill()
        if held:
            spill()
        digest, n = hashlib.sha256(), 0
        parts = [lines(store, ByteRange(r, 0, 1 << 62)) for r in runs]
        with store.open_output_stream(base) as out:
            for text in heapq.merge(*parts, key=self._key):
                raw = f"{text}\n".encode()
                digest.update(raw)
                out.write(raw)
                n += 1
        for r in runs:
            store.delete_file(r)
        return Written(base, n, digest.hexdigest())

    def commit(self, messages, batchId: int) -> None:
        store, root = _store(self.path)
        messages = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.sha256)
        manifest = f"{root}/_commits/{batchId}.json"
        store.create_dir(f"{root}/_commits")
        if store.get_file_info(manifest).type == fs.FileType.File:
            self._drop(store, messages)
            return
        entries = []
        for k, m in enumerate(messages):
            name = f"epoch-{batchId:09d}-{k:05d}.jsonl"
            store.move(m.file, f"{root}/{name}")
            entries.append({"file": name, "rows": m.rows, "sha256": m.sha256})
        with store.open_output_stream(f"{manifest}.new") as out:
            out.write(json.dumps({"epoch": batchId, "files": entries}, sort_keys=True).encode())
        store.move(f"{manifest}.new", manifest)

    def abort(self, messages, batchId: int) -> None:
        self._drop(_store(self.path)[0], [m for m in messages if m is not None])

    @staticmethod
    def _drop(store: fs.FileSystem, messages: list[Written]) -> None:
        for m in messages:
            if store.get_file_info(m.file).type == fs.FileType.File:
                store.delete_file(m.file)


class EventSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def streamWriter(self, schema, overwrite) -> EpochWriter:
        return EpochWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventSource)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, file, rows, sha256) of what was committed."""
    raw = spark.read.schema("epoch long, files array<struct<file string, rows long, sha256 string>>").json(f"{path}/_commits/*.json")
    return raw.selectExpr("epoch", "inline(files)")


def committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all epochs that were committed."""
    files = [f"{path}/{r['file']}" for r in manifests(spark, path).select("file").collect()]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
