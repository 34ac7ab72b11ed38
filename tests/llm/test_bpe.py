import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def samples():
    rng = random.Random(5)
    yield from ["", " ", "\n\n  x", "it's they'll", "a<|endoftext|>b", "é" * 50, "日本語のテキスト" * 40, "x" * 900, " " * 700, "ab\x1cc d e\x85f"]
    pool = "abcdefg ABC 0123 .,!?\n\t'sé日😀 \x1c\x85​"
    for _ in range(150):
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(1, 400)))
    for _ in range(40):
        yield "".join(rng.choice("abcdethinreon") for _ in range(rng.randrange(200, 900)))


@pytest.mark.parametrize("leaf,window", [(1024, 16), (64, 2), (17, 1), (5, 1)])
def test_equal_to_the_library(library, leaf, window):
    codec = bpe.Codec(leaf=leaf, window=window)
    for text in samples():
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_very_long_unsplit_text(library):
    codec = bpe.Codec()
    rng = random.Random(1)
    for text in ["".join(rng.choice("theonidareingtion") for _ in range(60_000)), " " * 50_000 + "x", "é" * 30_000, "ab1" * 9000]:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_joined(library):
    codec = bpe.Codec()
    rng = random.Random(8)
    words = ["it's", "naïve", "<|endoftext|>", "a<|endoftext|>b", "日本語のテキスト", "😀😀", "  ", "\n\n", "\t", "\u00a0", "3.1415", "don't", "x" * 40, "--'re", " \u2003 "]
    for n in (300, 3000, 30_000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n", "  "]) for _ in range(n))
        before = codec.joins
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.joins - before >= len(text) // 1024 - 1
    for at in range(1000, 1040):  # a special token and a contraction on every place around a cut
        text = "word " * 200 + "y" * (at - 1000) + "<|endoftext|>it're" + " more" * 200
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert codec.byte_joins == 0
    codec.encode("x" * 20_000)
    assert codec.byte_joins > 0


def test_documents_go_through_the_tree(spark, library):
    codec, long = bpe.Codec(), 0
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert codec.encode(text) == library.encode(text or "", add_special_tokens=False).ids
        long += len(text or "") > bpe.LEAF
    assert codec.joins >= long > 100


def test_every_code_point_splits_alike(library):
    codec = bpe.Codec()
    for start in range(0, 0x11000, 256):
        chars = [chr(c) for c in range(start, start + 256) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c} {c}{c}1{c}" for c in chars)
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_query_rows(spark, library):
    texts = [None, "", "one two", "one two", "x" * 20_000, "it's\n\n ok <|endoftext|>"]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, "null id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0)).collect() == []
    clash = bpe.encode(df)
    assert clash.columns == ["doc_id", "text", "token_ids"] and clash.schema["token_ids"].dataType.typeName() == "array"
    both = bpe.decode(bpe.encode(df, ids="ids"), ids="ids", text="again")
    assert both.columns == [*df.columns, "ids", "again"]
    assert all(r.again == (r.text or "") for r in both.collect())
