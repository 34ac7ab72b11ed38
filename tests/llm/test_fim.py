import hashlib
import random

import numpy as np
import pytest
import regex

from tidemark.llm import fim

TOKEN = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def samples():
    rng = random.Random(3)
    yield from ["", " ", "a", "  a b  ", "\n\n\t", "日本 語\x0b😀\x0c x", "a\x1cb\x85c d", "one<P>two three", "<S>", "x<M>", "a <P b> <", "word " * 5000, "x" * 10_000, " " * 3000]
    for _ in range(120):
        yield "".join(rng.choice(" \t\n\x0b\x0c\rab<>PSMé日😀") for _ in range(rng.randrange(0, 300)))


def expected(text, doc_id, rate=50, spm=80, seed=42):
    text = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = TOKEN.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_every_rank_is_found():
    for text in samples():
        tokens, units = fim.SkipList(text.encode()), TOKEN.findall(text)
        assert tokens.n == len(units), repr(text)
        chars = np.cumsum([0, *map(len, units)])
        size = np.cumsum([0, *(len(u.encode()) for u in units)])
        for rank in range(0, len(units) + 1, 1 + len(units) // 200):
            assert tokens.find(rank) == (chars[rank], size[rank])
        with pytest.raises(ValueError):
            tokens.find(len(units) + 1)


def test_lanes_are_thin_and_searches_short():
    tokens = fim.SkipList(b"word " * 100_000)
    sizes = [len(lane[1]) for lane in tokens.lanes]
    assert len(sizes) > 5 and sizes[-1] == tokens.n and sizes == sorted(sizes)
    assert all(2 < b / a < 8 for a, b in zip(sizes, sizes[1:]) if a > 50)
    rng = random.Random(1)
    for _ in range(500):
        tokens.find(rng.randrange(tokens.n + 1))
    assert tokens.taken < 500 * 60


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 0), (100, 100), (0, 80)])
def test_equal_to_brute_force(rate, spm):
    forms = set()
    for i, text in enumerate(samples()):
        n, form, prefix, middle, out = fim.cut(text.encode(), i, rate, spm)
        assert (n, form, prefix, middle, out.decode()) == expected(text, i, rate, spm)
        forms.add(form)
    assert rate == 0 or forms - {"plain"}


def test_rows(spark):
    texts = [None, *samples(), "same same", "same same"]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(5, "again of id five", "x", 1), (None, "null id here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = fim.transformed(df, rate=100)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored()).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.text, r.doc_id, rate=100)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    digests = {(r.doc_id, r.output_sha256): r for r in fim.digest(df).collect()}
    for i, text, _, _ in rows:
        n, form, prefix, middle, out = expected(text, i)
        r = digests[i, hashlib.sha256(out.encode()).hexdigest()]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, prefix, middle)
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert fim.digest(df.limit(0)).collect() == []
