import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import substrings


def brute(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    out = []
    for d, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return Counter(out)


def rows(seed, unit):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdeé fghi\n") for _ in range(n))
    passages = [prose(rng.randrange(unit // 2, 4 * unit)) for _ in range(8)]
    out = []
    for i in range(60):
        parts = [prose(rng.randrange(0, 2 * unit))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), prose(rng.randrange(0, unit))]
        out.append((i, "".join(parts)))
    out += [(100, out[3][1]), (101, out[3][1][:-5] + "zz"), (102, "x" * (3 * unit)), (103, "ab" * (2 * unit)), (104, "y" * unit), (105, "y" * (unit - 1)), (106, None), (107, ""), (None, out[5][1]), (3, out[3][1]), (3, prose(unit))]
    out += [(200 + i, prose(unit) + passages[0] + prose(unit)) for i in range(40)]
    return out


def answer(df):
    return Counter((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("length,passage,trigger,hot", [(400, 256, 64, 4096), (40, 40, 8, 4096), (40, 24, 8, 3), (25, 16, 16, 2)])
def test_brute_force(spark, length, passage, trigger, hot):
    data = rows(length, length)
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, spans string").repartition(6)
    got = substrings.dedup(df, length, passage, trigger, hot)
    assert answer(got) == brute(data, length)
    # what is told of shorter passages is what would be removed at their length
    shared = {(d, n) for d, n, gone, _, _ in brute(data, passage) if gone}
    assert {(r.doc_id, r.n_bytes) for r in got.filter("passage_words > 0").collect()} <= shared


def test_query_columns_and_empty(spark):
    data = rows(1, 400)[:20]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert Counter(tuple(r)[:5] for r in substrings.digest(df).collect()) == brute(data, 400)
    assert substrings.digest(df.limit(0)).collect() == []


def test_shorter_passages_are_told(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, short = prose(55), prose(40)
    texts = [f"{prose(80)} {shared} {prose(90)}", f"{prose(30)} {shared} {prose(70)}", f"{prose(60)} {short} {prose(9)}", f"{prose(60)} {short} {prose(9)}", prose(200)]
    got = {r.doc_id: r for r in substrings.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].repeats_passage for i in range(5)] == [True, True, False, False, False]
    assert [got[i].n_removed for i in range(5)] == [0] * 5
    assert got[0].passage_words == 55


def test_one_id_many_times_and_one_letter(spark):
    """Repeated rows of one id, null ids, and a periodic text that is longer than a block."""
    rng = random.Random(7)
    text = "".join(rng.choice("abcdef ghij\n") for _ in range(3000))
    rows = [(7, text)] * 3000 + [(None, text)] * 2000 + [(8, "y" * 3_000_000), (9, "ab c" * 200_000), (-(2**63), text)]
    got = answer(substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    empty = hashlib.sha256(b"").hexdigest()
    assert got == {(7, 3000, 3000, 1, empty): 3000, (None, 3000, 3000, 1, empty): 2000, (8, 3_000_000, 3_000_000, 1, empty): 1, (9, 800_000, 800_000, 1, empty): 1, (-(2**63), 3000, 3000, 1, empty): 1}


def test_repetitions_are_one_row():
    found = substrings.phrases([b"x" * 10_000], [10_000 - 255])
    assert len(found[0]) < 500 and found[5].sum() == 10_000 - 255


def test_blocks_of_a_long_text(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef ") for _ in range(5000))
    data = [(1, text), (2, text[100:4000]), (3, "q" * 2000)]
    monkeypatch.setattr(substrings, "CHUNK", 700)
    parse = substrings._parse(400, 256, 64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text.encode()])], ["d", "th", "raw"])
    whole = pa.Table.from_batches(parse([batch])).to_pylist()
    covered = sorted(p for r in whole for p in range(r["s"], r["s"] + r["width"] * r["times"]))
    assert covered == list(range(5000 - 255))
    assert answer(substrings.dedup(spark.createDataFrame(data, "doc_id long, text string"))) == brute(data, 400)


def test_windows_come_in_corpus_order():
    rng = random.Random(2)
    at = np.array([rng.randrange(0, 9) for _ in range(40)])
    bodies = [bytes(rng.choice(b"ab\0") for _ in range(k + rng.randrange(8, 33))) for k in at.tolist()]
    group, width = np.zeros(40, int), at + 1
    entry, place, before, after = substrings.matches(group, bodies, at, width, 32, 16, 8)
    assert len(entry) == width.sum()
    for k, a, left, right in zip(entry.tolist(), place.tolist(), before.tolist(), after.tolist()):
        x, best = at[k] - a, 0
        for other in range(40):
            b = at[other] - x
            if other == k or b < 0 or bodies[k][a : at[k]] != bodies[other][b : at[other]]:
                continue
            mine, its = bodies[k][at[k] :][:32], bodies[other][at[other] :][:32]
            best = max(best, x + next((i for i, (p, q) in enumerate(zip(mine, its)) if p != q), min(len(mine), len(its))))
        assert max(left, right) == best
