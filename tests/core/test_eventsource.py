"""The data source: ranges, filters, error rows, growing files; the sink: epochs that come again."""

import random

import pytest
from pyspark.sql import functions as F

from tests.core.test_detector import events
from tidemark.model import FEATURE_COLUMNS
from tidemark.sources import eventsource, files


@pytest.fixture(scope="module")
def source(spark):
    eventsource.register(spark)
    return spark


def text(rows):
    return "".join("\t".join(str(r[c]) for c in FEATURE_COLUMNS) + "\n" for r in rows)


@pytest.mark.parametrize("size", [1, 7, 97, 1000, 10**6])
def test_ranges_hold_every_line_once(tmp_path, size):
    rng = random.Random(size)
    want = ["", "x", "é" * 40, *["".join(rng.choice("ab\té") for _ in range(rng.randrange(60))) for _ in range(60)]]
    for end in ("\n", ""):
        file = tmp_path / f"f{len(end)}"
        file.write_bytes(("\n".join(want) + end).encode())
        store, path = eventsource._store(str(file))
        got = [x for part in eventsource.ranges(path, 0, file.stat().st_size, size) for x in eventsource.lines(store, part)]
        assert got == want if end else got == (want if want[-1] else want[:-1])


def test_equal_to_the_plain_reader(source, tmp_path):
    rows = events(500)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.tsv").write_text("# a comment\n" + text(rows[k::3]))
    path = str(tmp_path / "in")
    got = source.read.format(eventsource.NAME).option("rangeBytes", 2000).load(path)
    assert got.rdd.getNumPartitions() > 10
    plain = files.read_tsv(source, path)
    assert got.filter("problem is null").select(*FEATURE_COLUMNS).exceptAll(plain).count() == 0 and got.count() == plain.count() == 500
    some = got.filter((F.col("ts") >= 100_000) & (F.col("ts") < 200_000) & (F.col("status") == "declined") & F.col("bin").isin("000001", "000002"))
    want = plain.filter((F.col("ts") >= 100_000) & (F.col("ts") < 200_000) & (F.col("status") == "declined") & F.col("bin").isin("000001", "000002"))
    assert some.select(*FEATURE_COLUMNS).exceptAll(want).count() == 0 and some.count() == want.count() > 0
    # nothing is left for Spark to filter
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()


def test_lines_that_are_no_events(source, tmp_path):
    good = text(events(1)).rstrip("\n").split("\t")
    at = {c: FEATURE_COLUMNS.index(c) for c in FEATURE_COLUMNS}
    put = lambda **changed: "\t".join(str(changed.get(c, good[at[c]])) for c in FEATURE_COLUMNS)
    wrong = {"a\tb": "2 fields, not 9", put(ts="soon"): "ts is no integer", put(amount_paise=2**63): "amount_paise is out of range", put(status="pending"): "unknown status", put(amount_paise=-1): "amount is negative", put(ip=""): "ip is empty"}
    file = tmp_path / "x.tsv"
    file.write_text("\n".join([*wrong, "\t".join(good)]))
    rows = source.read.format(eventsource.NAME).load(str(file)).collect()
    assert {r.line: r.problem for r in rows if r.problem} == wrong and sum(r.problem is None for r in rows) == 1
    with pytest.raises(Exception, match="no/such"):
        source.read.format(eventsource.NAME).load("/no/such/file").count()


def test_growing_files_into_epochs(source, tmp_path):
    rows = events(300)
    (tmp_path / "in").mkdir()
    first, second = tmp_path / "in" / "a.tsv", tmp_path / "in" / "b.tsv"
    out, schema = str(tmp_path / "out"), eventsource.SCHEMA
    whole = text(rows[:200])
    half = len(whole) // 2  # in the middle of a line
    first.write_text(whole[:half])

    def run():
        stream = source.readStream.format(eventsource.NAME).option("rangeBytes", 2000).load(str(tmp_path / "in"))
        stream.writeStream.format(eventsource.NAME).option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    run()
    with first.open("a") as more:
        more.write(whole[half:])
    second.write_text(text(rows[200:]))
    run()
    run()
    got = eventsource.committed(source, out, schema)
    plain = files.read_tsv(source, str(tmp_path / "in"))
    assert got.count() == 300 and got.select(*FEATURE_COLUMNS).exceptAll(plain).count() == 0
    names = [f for f in sorted(p.name for p in (tmp_path / "out").iterdir()) if f.startswith("epoch")]
    listed = {r.file: r.sha256 for r in eventsource.manifests(source, out).collect()}
    assert set(listed) == set(names)
    for name in names:
        rows_of = [eventsource.json.loads(x)["ts"] for x in (tmp_path / "out" / name).read_text().splitlines()]
        assert rows_of == sorted(rows_of)
        assert eventsource.hashlib.sha256((tmp_path / "out" / name).read_bytes()).hexdigest() == listed[name]


def test_an_epoch_that_comes_again_changes_no_byte(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(eventsource, "RUN", 7)
    rows = spark.createDataFrame([dict(r, ts=None if r["seq"] % 9 == 4 else r["ts"]) for r in events(60)]).collect()
    writer = eventsource.EpochWriter(str(tmp_path), list(rows[0].asDict()))
    parts = [rows[:25], rows[25:], []]
    writer.commit([writer.write(iter(p)) for p in parts], 4)
    before = {p.name: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    again = [writer.write(iter(random.Random(1).sample(p, len(p)))) for p in reversed(parts)]
    assert sorted(m.sha256 for m in again if m.rows) == sorted(r["sha256"] for r in eventsource.json.loads(before["4.json"])["files"])
    writer.commit(again, 4)
    assert {p.name: p.read_bytes() for p in tmp_path.rglob("*") if p.is_file() and "_pending" not in str(p)} == {k: v for k, v in before.items() if k.startswith(("epoch", "4"))}
    writer.abort([writer.write(iter(rows))], 5)
    assert not [p for p in (tmp_path / "_pending").iterdir() if p.stat().st_size]
