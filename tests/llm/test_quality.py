import random
import re
from collections import Counter

from tidemark.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def sample():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 8)))
    out = [(i, " ".join(word() + (". " if k % 9 == 8 else "") for k in range(rng.randrange(90, 400))), 1) for i in range(150)]
    out += [(200 + i, "!! ".join([word().upper() for _ in range(40)] * 3) + "!!", 0) for i in range(15)]
    out += [(300 + i, " ".join([word()] * 50 + [word()] * 80), 0) for i in range(10)]
    out += [(400 + i, " ".join(word() + "###" for _ in range(100)), 0) for i in range(15)]
    return out


def test_base_and_verdict(spark):
    rows = sample() + [(900, None, 0), (901, "", 0), (902, "a b\n\n a b\na b\n\x0b\na b a b a b", 0), (903, "x " * 30_000, 0), (None, "one two", 0), (7, "dup id # a", 0), (904, "tab\tand\x0bvt\x0cff\rcr nbsp\xa0x", 0)]
    df = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, good int, n_words string")
    got = Counter()
    kept = Counter()
    for r in quality.digest(df).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
        kept[r.doc_id] += r.kept
        assert not (r.base_failed and r.kept)
    assert got == Counter((d, *brute(t)) for d, t, _ in rows)
    for d, _, good in sample():
        if good:
            assert kept[d] == 1, d
        elif d != 7:
            assert kept[d] == 0, d
    assert quality.digest(df.limit(0)).collect() == []


def test_fit_finds_accuracies():
    rng = random.Random(9)
    right = [0.95, 0.9, 0.85, 0.6]
    counts = Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < 0.8 else -1
        counts[tuple(0 if rng.random() < 0.2 else (y if rng.random() < a else -y) for a in right)] += 1
    prior, odds = quality.fit(sorted(counts.items()))
    gain = [o[1] - o[-1] for o in odds]
    assert gain[0] > gain[1] > gain[2] > gain[3] > 0 and 0.9 < prior < 1.9
    assert quality.fit([]) == (0.0, [])


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = quality.measured(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
