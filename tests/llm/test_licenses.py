import difflib

from tidemark.llm import licenses


def plain(line):
    """Brute force: the template with the fewest differing words against every template."""
    have, best = licenses.words(line), None
    for name, text in licenses.TEMPLATES.items():
        want = licenses.words(text)
        parts = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if parts:
            span = parts[-1].b + parts[-1].size - parts[0].b
            same = sum(m.size for m in parts)
            if same / max(len(want), span) >= 0.8 and not licenses.refuted(want, have[parts[0].b : parts[0].b + span]):
                best = min(best or (9e9,), (len(want) + span - 2 * same, -len(want), name))
    return best and best[2]


LINES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "released under the mit license", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3.", "This text is licensed under the GNU General Public License, version 3.",
    "They asked for a license to drive.", "No warranty was given by anybody here.", "Licensed under the Apache License, Version 2.0. Then more words of another kind follow here.",
]


def test_lines_against_every_template():
    scanner = licenses.Scanner()
    for line in LINES:
        hit = scanner.block(line)
        assert (hit and hit[0]) == plain(line), line
    assert scanner.block(LINES[8])[3:] == (2, ["-work +text"])


def test_scan_rows(spark):
    long = licenses.TEMPLATES["MIT"].replace(", subject", ",\nsubject").replace("conditions: ", "conditions:\n")
    rows = [(1, "some words\n" + LINES[0] + "\nmore words"), (2, f"a\n\n{long.replace('Software', 'Program')}\n\nb"), (3, None), (4, ""), (5, "license " * 20_000), (6, "plain text"), (None, LINES[1]), (1, LINES[1] + "\n" + "x y z\n" * 3 + "\n" + LINES[1]), (7, LINES[9])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_blocks int")
    got = sorted((r.doc_id or -1, r.n_licenses, r.licenses) for r in licenses.digest(df).collect())
    assert got == sorted([(1, 1, "Apache-2.0-notice"), (2, 1, "MIT"), (3, 0, ""), (4, 0, ""), (5, 0, ""), (6, 0, ""), (-1, 1, "MIT-notice"), (1, 2, "MIT-notice,MIT-notice"), (7, 0, "")])
    assert licenses.digest(df.limit(0)).collect() == []


def test_planted_lines_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in licenses.digest(docs).collect()}
    for r in docs.collect():
        want = sorted(x for x in (plain(line) for line in (r.text or "").split("\n") if "icense" in line) if x)
        assert found[r.doc_id].licenses == ",".join(want), (r.doc_id, want)


def names(text):
    return [m[0] for m in licenses.Scanner().scan(text)[1]]


def test_paragraphs_and_wrapped_lines():
    import textwrap

    cuts = {"MIT": ["subject to the following conditions: "], "BSD-2-Clause": ["conditions are met: ", "following disclaimer. "], "GPL-3.0-or-later": ["any later version. "], "Apache-2.0": ["compliance with the License. ", "LICENSE-2.0 "]}
    for name, ends in cuts.items():
        text = licenses.TEMPLATES[name]
        for end in ends:
            assert end in text
            text = text.replace(end, end.strip() + "\n\n", 1)
        wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 70)) for p in text.split("\n\n"))
        for form in (text, wrapped, "Intro words.\n\n" + wrapped.replace("\n", "\n  ") + "\n\nint main() {}"):
            assert names(form) == [name], (name, form)


def test_notice_in_a_long_line():
    prose = " ".join(f"word{k} of prose" for k in range(40))
    for name, text in licenses.TEMPLATES.items():
        for line in (f"{prose} {text}", f"{text} {prose}", f"{prose} {text} {prose}"):
            assert names(line) == [name], (name, line)


def test_case_and_close_templates():
    for name, text in licenses.TEMPLATES.items():
        assert names(text.lower()) == [name] and names(text.upper()) == [name], name
    # a template that is given under many names is found, whichever comes first
    same = {f"T{k}": "Released under the Sun License." for k in range(9)} | {"wanted": "Released under the Moon License."}
    assert [m[0] for m in licenses.Scanner(same).scan("released under the moon license")[1]] == ["wanted"]


def test_every_confirmable_variant_is_found():
    # as many words as may differ are replaced, among words of prose, but for those that refute
    scanner = licenses.Scanner()
    prose = "is in the river a stone walks and with hills of green to this morning".split()
    for name, want in scanner.words.items():
        spare = len(want) - scanner.need[name]
        text = [prose[k % len(prose)] if 0 < k <= spare and not licenses.re.search(licenses.CUE + "|[0-9]", w) and not licenses.parts([w]) & licenses.VARIANT else w for k, w in enumerate(want)]
        assert scanner.found(prose + text + prose, [True] * (len(text) + 2 * len(prose))), name


def test_several_notices_on_one_line():
    t = licenses.TEMPLATES
    assert names("Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT-notice", "Apache-2.0-notice"]
    assert names("Text: Licensed under CC BY-SA 4.0. Code: Released under the MIT License.") == ["CC-BY-SA-4.0", "MIT-notice"]
    assert names("Released under the MIT License. " * 3) == ["MIT-notice"] * 3
    line = " ".join(t.values())
    assert sorted(names(line)) == sorted(t), names(line)


def test_versions_and_variants_refute():
    gpl = "This work is licensed under the GNU General Public License, version {}."
    assert [names(gpl.format(k)) for k in (2, 3, 4)] == [["GPL-2.0-notice"], ["GPL-3.0-notice"], []]
    lesser = gpl.replace("General", "Lesser General")
    assert [names(lesser.format(k)) for k in ("2.1", "3", "2")] == [["LGPL-2.1-notice"], ["LGPL-notice"], []]
    for kind in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND"):
        for version in ("2.5", "3.0", "4.0"):
            assert names(f"Some words. Licensed under CC {kind} {version}. And more.") == ([] if version == "2.5" else [f"CC-{kind}-{version}"])
    older = licenses.TEMPLATES["GPL-3.0-or-later"].replace("version 3", "version 2")
    assert names(older) == ["GPL-2.0-or-later"]
    assert names(older.replace(", or (at your option) any later version", "")) == []


def test_identifier_lines():
    for name in licenses.IDENTIFIERS:
        assert names(f"# SPDX-License-Identifier: {name}\nimport os\n") == [f"SPDX {name}"]
    assert names("// SPDX-License-Identifier: Unknown-1.0") == []


def test_full_texts_with_numbers_and_comment_marks():
    import textwrap

    prose = "the river is wide and a stone walks over it " * 40
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "LGPL-2.1-or-later"):
        text = licenses.TEMPLATES[name]
        for k, start in enumerate(["Redistributions of source", "Redistributions in binary", "Neither the name", "The origin of", "Altered source", "This notice may"]):
            text = text.replace(start, f"{k % 3 + 1}. {start}")
        code = "\n".join(" * " + line for line in textwrap.wrap(text, 72))
        assert names(f"{prose}\n/*\n * Copyright (c) 2020, 2021 A. Person\n{code}\n */\n{prose}") == [name], name


def test_a_place_goes_to_the_template_that_saves_most_there():
    table = {"Sun": "Released under the Sun License.", "Moon": "Released under the Moon License."}
    for text, want in (("Released under the Sun License. Released under the Moon License.", ["Sun", "Moon"]), ("Released under the Moon License. Released under the Sun License. Released under the Sun License.", ["Moon", "Sun", "Sun"])):
        assert [m[0] for m in licenses.Scanner(table).scan(text)[1]] == want
