import hashlib
from collections import defaultdict

import duckdb

from tidemark.llm import lines


def brute(rows):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans(lines._UPPER, lines._LOWER)
    holders = defaultdict(set)
    low = float("-inf")
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[line.strip(strip).translate(lower)].add(low if d is None else d)
    out = []
    for d, t in rows:
        all_lines, kept = (t or "").split("\n"), []
        for line in all_lines:
            key = line.strip(strip).translate(lower)
            gone = len(key) >= 20 and len(holders[key]) >= 3 and max(holders[key]) != (low if d is None else d)
            if not gone:
                kept.append(line)
        out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


LONG = "This line is long enough to count"
ROWS = [
    (1, f"a\n{LONG}\nb"), (2, f"  {LONG.upper()}\t\nx\n{LONG}"), (3, f"{LONG}\r\n\n{LONG}"), (4, None), (5, ""), (6, "\n\n"),
    (7, "exactly nineteen ch"), (8, "exactly nineteen ch"), (9, "exactly nineteen ch"), (10, "ÄÄÄ only ascii is lowered"), (11, "äÄÄ only ascii is lowered"),
    (12, "twenty characters ab"), (13, "twenty characters ab"), (13, "twenty characters ab\nagain"), (14, "Twenty characters ab"),
    (None, LONG), (None, f"{LONG}\nzz"), (15, "two documents hold this line"), (16, "two documents hold this line"), (17, (LONG + "\n") * 3000 + "end"), (1, f"{LONG}"),
]


def test_digest_is_brute_force(spark):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, h1 int, dropped string")
    for batches in (1, 4, 9):
        assert sorted(map(tuple, lines.digest(df).collect()), key=str) == brute(ROWS)
        got = lines.dedup(df, batches=batches)
        assert got.columns == [*df.columns, "kept_text", "n_lines", "n_dropped"] and got.count() == len(ROWS)
    assert lines.digest(df.limit(0)).collect() == []


def test_sql_twin(spark):
    rows = [(d, t) for d, t in ROWS if d is not None]
    rows = list({d: (d, t) for d, t in rows}.values())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.sql(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({lines.ORACLE})").fetchall(), key=str) == brute(rows)


def test_runs_compact_and_anti_join(spark):
    store = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.range(20).selectExpr(f"id + {k * 100} as doc", f"id + {k * 10} as h1", "id as h2").selectExpr("doc", "h1", "h1 as h2")
        fresh = store.novel(batch).count()
        assert fresh == (20 if k == 0 else 10)
        store.add(batch)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert store.joins == 4 and store.compactions == 3
    # a key stands in one run, and counts and largest ids are whole
    assert sum(r.count() for level in store.levels for r in level) == 60
    found = {r.h1: (r.n_docs, r.max_doc) for r in store.merged().collect()}
    assert found == {h: (1 if h < 10 or h >= 50 else 2, (min(h // 10, 4)) * 100 + h - min(h // 10, 4) * 10) for h in range(60)}


def test_query_goes_through_the_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lines.document_lines(docs)
    store = lines.runs_of(found)
    assert store.joins == 3 and store.compactions == 1
    assert all(g.count() for g in store.gains) and all(r.count() for level in store.levels for r in level)
    plain = found.select("doc", "h1", "h2").distinct().groupBy("h1", "h2").agg({"doc": "max", "*": "count"}).selectExpr("h1", "h2", "`count(1)` as n_docs", "`max(doc)` as max_doc")
    assert store.merged().exceptAll(plain).count() == 0 == plain.exceptAll(store.merged()).count()
