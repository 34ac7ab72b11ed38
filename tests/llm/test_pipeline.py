import hashlib
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_components, brute_fp
from tidemark.llm import bpe, mixing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, folder = [], tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        df = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == columns, name
        df.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append([r.asDict() for r in docs.collect()])
    return [[r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], *out]


def test_each_stage_against_brute_force(stages):
    start, clean, lined, single, mixed, coded = stages
    toxic = dict(duckdb.sql(f"select doc_id, max(toxic) from '{SF}/labels.parquet' group by 1").fetchall())
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in clean}
    assert len(gone) > 30 and sum(toxic.get(d, 1) for d in gone) >= 0.9 * len(gone)
    assert all(r in start for r in clean)
    # lines
    want = {d: h for d, _, _, h in brute_lines([(r["doc_id"], r["text"]) for r in clean])}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in lined} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lined)
    # near copies
    ids = [r["doc_id"] for r in lined]
    named = brute_components([brute_fp(r["text"]) for r in lined], ids)
    assert sorted(r["doc_id"] for r in single) == sorted(set(named)) and len(single) < len(lined)
    assert all(r in lined for r in single)
    # mix
    count = Counter(r["doc_id"] for r in mixed)
    assert all(r in single for r in mixed) and max(count.values()) <= 3
    words = {r["doc_id"]: len(__import__("re").findall(mixing.WORD, r["text"])) for r in single}
    assert abs(sum(words[d] * n for d, n in count.items()) - sum(words.values())) < 0.3 * sum(words.values())
    # encoding
    library = Tokenizer.from_file(bpe.default_vocabulary())
    text = {r["doc_id"]: r["text"] for r in single}
    assert Counter(r["doc_id"] for r in coded) == count
    for r in coded[::7]:
        ids = library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())


def test_run_is_the_stages(spark, stages):
    got = Counter(str(sorted(r.asDict().items())) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter(str(sorted(r.items())) for r in stages[-1])


ODD = [
    (1, None, None, None, None, "r", 1, "k"), (2, "", "en", "a", 0, None, None, "k"), (None, "no id here at all", "en", "a", 17, "r", 1, "k"), (3, "word " * 30_000, "en", "b", 150_000, "r", 2, "k"),
    (4, "This line is long enough to count\nx", "en", "b", 35, "r", 3, "k"), (5, "This line is long enough to count\ny y", "en", None, 36, "r", 3, "k"), (6, "This line is long enough to count", "fr", "a", 33, "r", 3, "k"),
    (6, "This line is long enough to count", "fr", "a", 33, "r", 3, "k"), (7, "one two three four five six", "en", "a", 27, "r", 3, "k"), (7, "another text of the same id", "en", "a", 27, "r", 3, "k"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size int, n_dropped string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names, and empty tables go through each stage."""
    names = SCHEMA + ", score double, _n int, _id int, tie int, kept_text string, fp long, copies int, passages string, evidence int"
    for rows in (ODD, []):
        labels = [(1, 1, 0), (None, None, None), (4, 1, 1), (7, 0, 0)] if rows else []
        folder = tmp_path / str(len(rows))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = spark.createDataFrame([(*r, 0.5, 1, 2, 3, "z", 4, 5, "p", 6) for r in rows], names)
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(folder))
            if name != "bpe":
                assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
                extra = out.select("_row", "size", "n_dropped", "score", "_n", "tie", "kept_text").distinct().collect()
                assert all(r.kept_text == "z" and r.tie == 3 for r in extra)
            docs = spark.createDataFrame(out.collect(), out.schema)
            counts.append(docs.count())
        if rows:
            assert counts[0] == counts[1] == len(rows) and counts[2] < len(rows) and counts[3] == counts[4]
        else:
            assert counts == [0] * 5
