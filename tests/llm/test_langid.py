import random
import zlib

import numpy as np

from tidemark.llm import langid


def test_forward_sums_all_segmentations():
    vocabulary = ["a", "b", "ab", "ba", "aba", langid.MARK, langid.MARK + "a", "é"]
    rng = np.random.default_rng(0)
    p = rng.random((len(vocabulary) + 1, 2)) / 10
    model = langid.Model(["x", "y"], vocabulary, p, np.zeros(2))
    index = {v: i for i, v in enumerate(vocabulary)}

    def every(word):
        if not word:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(word) + 1):
            k = index.get(word[:n], len(vocabulary) if n == 1 else None)
            if k is not None:
                total = total + p[k] * every(word[n:])
        return total

    words = [langid.MARK + w for w in ["abab", "a", "bbaé", "zab", "ababab", "😀b"]]
    assert np.allclose(model.words(words), [np.log(every(w)) for w in words])


def corpus():
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "tion", "er", "ou", "th"], "de": ["ung", "sch", "keit", "ei", "ß", "ch"], "fr": ["eau", "que", "tion", "é", "ou", "aux"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
        rows.append((i, text, lang))
    return rows


def test_digest(spark):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, "the thing", "en"), (1003, "schung keit " * 30_000, None), (1004, "x" * 5000, None), (5, rows[5][1], "de")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = langid.digest(df).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held) and held
    assert all(r.lang_pred == truth[r.doc_id] for r in held if r.doc_id in truth)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got) and by[1004].lang_pred in ("en", "de", "fr")
    assert langid.digest(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.digest(df.filter("lang is null")).collect()} == {"und"}


def test_held_out_languages_are_not_read(spark):
    rows = corpus()
    wrong = [(i, t, "fr" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, langid.digest(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect())) for x in (rows, wrong))
    assert a == b


def test_long_words_and_pieces_are_whole():
    import math

    chosen = langid.pieces()
    assert langid.MARK + "international" in chosen and langid.MARK + "understanding" in chosen
    vocabulary = ["a", "b", "ab", "ba", "aba", "b" * 14, langid.MARK, langid.MARK + "a"]
    rng = np.random.default_rng(1)
    p = rng.random((len(vocabulary) + 1, 2)) / 10
    model = langid.Model(["x", "y"], vocabulary, p, np.zeros(2))
    index = {v: i for i, v in enumerate(vocabulary)}

    def plain(word, lang):
        # forward sums in logs, character by character
        f = [0.0]
        for end in range(1, len(word) + 1):
            terms = []
            for start in range(max(0, end - 14), end):
                k = index.get(word[start:end], len(vocabulary) if end == start + 1 else None)
                if k is not None:
                    terms.append(f[start] + math.log(p[k, lang]))
            top = max(terms)
            f.append(top + math.log(sum(math.exp(t - top) for t in terms)))
        return f[-1]

    texts = ["abba" * 30, "b" * 47, "b" * 48, "b" * 14, "ab" * 1500 + "é", "ba" * 1024 + "b" * 40, "a", "zz" * 200]
    words = [w for t in texts for w in langid.words_of(t)]
    assert words == [langid.MARK + t for t in texts]
    assert np.allclose(model.words(words), [[plain(w, lang) for lang in range(2)] for w in words], rtol=1e-9)


def test_rare_scripts_teach_and_clashing_names(spark):
    rows = [(i, ("한국어 " if i % 2 else "中文字 ") * 5 + "\U00020000" * 48, "ko" if i % 2 else "zh", "z") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(df)
    assert np.isfinite(model.probability).all() and (model.probability > 0).all()
    out = langid.predict(df.withColumn("score", df["doc_id"]), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert all(r.lang_pred == r.lang for r in out.collect())


def test_sample_bounds_rows_not_ids(spark):
    # one id has most rows, one row is repeated, one language has no ids; each leaves the bound
    rows = [(7, f"word{k}", "en") for k in range(5000)] + [(8, "same text", "de")] * 5000 + [(k, f"wort{k}", "de") for k in range(100, 130)] + [(None, f"mot{k}", "fr") for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {}
    for r in langid.sample(df, 20).collect():
        got.setdefault(r.lang, []).append(r.text)
    assert {k: len(v) for k, v in got.items()} == {"en": 20, "de": 20, "fr": 20}
    assert all(len(set(v)) == len(v) for v in got.values())
    whole = langid.sample(df.filter("lang = 'de'"), 10_000).collect()
    assert sorted(r.text for r in whole) == sorted({t for i, t, lang in rows if lang == "de" and zlib.crc32(str(i).encode()) % 5})


def test_expected_counts_hold_where_likelihoods_underflow():
    vocabulary = ["a", "b", "ab", "c"]
    rng = np.random.default_rng(3)
    p = rng.random((len(vocabulary) + 1, 2))
    model = langid.Model(["x", "y"], vocabulary, p / p.sum(axis=0), np.zeros(2))
    words = ["abcab" * 9, "cab" * 15, "aabbé" * 9]
    graphs = [(at, codes.shape[1], model.lattice.arcs(codes)) for at, codes in langid._by_length(words)]
    n = np.array([[3.0, 0.0], [2.0, 5.0], [0.0, 4.0]])
    plain = langid._expected(model, graphs, n, longer=False)
    logs, langid.TINY = langid.TINY, np.inf
    try:
        assert np.allclose(langid._expected(model, graphs, n, longer=False), plain, rtol=1e-10)
    finally:
        langid.TINY = logs
    # 48 characters that are as good as unknown to both languages
    model.probability = np.vstack([p[:-1] / p[:-1].sum(axis=0), np.full((1, 2), 1e-12)])
    (codes,) = [c for _, c in langid._by_length(["é" * 48])]
    got = langid._expected(model, [(np.array([0]), 48, model.lattice.arcs(codes))], np.array([[1.0, 0.0]]), longer=False)
    want = 48 + langid.SMOOTHING
    assert np.isfinite(got).all() and np.allclose(got[-1, 0], want / (want + 4 * langid.SMOOTHING))
