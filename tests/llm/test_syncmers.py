import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import syncmers

MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 29)


def brute_anchors(raw):
    """Closed syncmers by their definition, one stretch at a time."""
    out, k, s = [], syncmers.K, syncmers.S
    for i in range(len(raw) - k + 1):
        order = [mixed((int.from_bytes(raw[j : j + s], "little") * 0x9E3779B97F4A7C15) & MASK) for j in range(i, i + k - s + 1)]
        if order.index(min(order)) in (0, k - s):
            value = 0
            for j in range(i, i + k, 8):
                value = mixed(((value ^ int.from_bytes(raw[j : j + 8], "little")) * 0x9E3779B97F4A7C15) & MASK)
            out.append((i, value >> 34))
    return out


def brute_like(a, b):
    """2 * longest ascending chain of the i-th with the i-th equal anchor / all anchors."""
    if a == b:
        return 1.0
    x, y = brute_anchors(a), brute_anchors(b)
    seen, pairs = {}, []
    for side in (x, y):
        count, turns = {}, []
        for _, v in side:
            count[v] = count.get(v, 0) + 1
            turns.append((v, count[v]))
        seen[len(seen)] = turns
    there = {v: j for j, v in enumerate(seen[1])}
    pairs = [there[v] for v in seen[0] if v in there]
    best = []
    for i, p in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(i) if pairs[j] < p), default=0))
    return 2.0 * max(best, default=0) / (len(x) + len(y)) if x and y else 0.0


def texts(seed=4, n=30):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklé日") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 150))) for _ in range(n)]


def test_anchors_equal_the_definition():
    cases = [t.encode() for t in texts()] + [b"", b"x" * 39, b"x" * 40, b"a" * 300, b"abc" * 200, bytes(range(256)) * 2, b"\n" * 41]
    for raw in cases:
        at, value = syncmers.anchors(raw)
        assert list(zip(at.tolist(), value.tolist())) == brute_anchors(raw)
        if len(raw) >= syncmers.K:
            assert len(at) == 0 or np.diff(at, prepend=0).max() <= syncmers.K - syncmers.S
    rng = random.Random(2)
    long = bytes(rng.randrange(97, 123) for _ in range(60_000))
    assert 1.5 < len(syncmers.anchors(long)[0]) * (syncmers.K - syncmers.S + 1) / len(long) < 2.5


def test_blocks_and_context(monkeypatch):
    raw = " ".join(texts(9, 10)).encode()
    whole = syncmers.anchors(raw)
    monkeypatch.setattr(syncmers, "BLOCK", 101)
    parts = syncmers.anchors(raw)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    inside = syncmers.anchors(raw[500:1500])  # anchors of a passage are those it has anywhere
    at = (whole[0] >= 500) & (whole[0] <= 1500 - syncmers.K)
    assert (inside[0] + 500 == whole[0][at]).all() and (inside[1] == whole[1][at]).all()


def test_fingerprints_read_back():
    for text in texts():
        at, value = syncmers.anchors(text.encode())
        back = syncmers.read_back(syncmers.written_out(text.encode()))
        assert (back[0] == at).all() and (back[1] == value.astype(np.int64)).all()
    assert syncmers.written_out(b"") == ""
    assert syncmers.written_out(b"short") != syncmers.written_out(b"shore")
    assert syncmers.like(syncmers.written_out(b"short"), syncmers.written_out(b"shore")) == 0.0


def test_likeness_equals_brute_force():
    rng = random.Random(6)
    pool = texts(7, 12)
    for _ in range(60):
        a, b = rng.choice(pool), rng.choice(pool)
        cut = rng.randrange(len(a))
        for x, y in [(a, b), (a, a[:cut] + b[cut:]), (a, a[cut:] + a[:cut]), (a + b + a, b + a), (a, a + " " + a)]:
            got = syncmers.like(syncmers.written_out(x.encode()), syncmers.written_out(y.encode()))
            assert got == brute_like(x.encode(), y.encode())
            assert got == syncmers.like(syncmers.written_out(y.encode()), syncmers.written_out(x.encode())) or x == y + x
            assert 0.0 <= got <= 1.0


def expected(rows):
    """Rows of the query, one at a time."""
    out = []
    for (doc_id, _, text), (_, _, after) in zip(rows, rows[1:] + rows[:1]):
        new = syncmers.edited(text, after)
        marks = [syncmers.written_out(x.encode()) for x in (text, new)]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *marks, brute_like(text.encode(), new.encode()), brute_like(text.encode(), after.encode())))
    return out


def check(spark, rows, ranges):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, fingerprint string, n_chars int")
    # the hash that orders equal ids is Spark's, so it is asked for
    keyed = [(r.doc_id, r.h, r.t) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t")).collect()]
    keyed.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    made = syncmers.beside_successors(df.repartition(5), ranges)
    got = [tuple(r) for r in made.select("doc_id", "n_chars", F.sha2("edited", 256), "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[1])
    assert sorted(got, key=order) == sorted(expected(keyed), key=order)


def test_rows(spark):
    pool = texts(11, 40)
    rows = [(i * 3 - 20, t) for i, t in enumerate(pool)]
    rows += [(None, "no id, first"), (None, None), (None, "no id, first"), (7, ""), (7, "twice the id 7"), (7, "twice the id 7"), (2**63 - 1, "last of all 日本 " * 30), (-(2**63), pool[3])]
    for ranges in (1, 2, 7, 200):
        check(spark, rows, ranges)
    check(spark, [(5, pool[0])], None)
    check(spark, [(5, None)], None)
    check(spark, [(5, pool[0]), (6, pool[1])], None)
    check(spark, [(5, pool[0])] * 20, 4)


def test_query_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = syncmers.digest(docs).toPandas()
    assert list(got.columns) == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert len(got) == docs.count() and got.doc_id.is_unique
    source = docs.toPandas().set_index("doc_id")
    assert (source.loc[got.doc_id, "text"].str.len().to_numpy() == got.n_chars).all()
    long = got[got.n_chars > 1000]
    assert long.near_edited.median() > 0.4 and long.near_next.median() < 0.1
    by_text = got.assign(text=source.loc[got.doc_id, "text"].to_numpy()).groupby("text").fingerprint.nunique()
    assert (by_text == 1).all()
    assert syncmers.digest(docs.limit(0)).collect() == []


def test_columns(spark):
    df = spark.createDataFrame([("some text that is long enough for anchors, to be sure of that", ""), (None, None)], "text string, other string")
    made = syncmers.fingerprinted(df)
    got = made.withColumn("l", syncmers.likeness(F.col("fingerprint"), F.col("fingerprint"))).withColumn("m", syncmers.likeness(F.col("fingerprint"), F.col("other"))).collect()
    assert [r.l for r in got] == [1.0, 1.0] and got[1].fingerprint == "" and got[0].m == 0.0 and got[1].m is None
