"""License scans by conditional compression.

Candidate blocks are the stretches of a text around its cue words, as wide to both sides as the
longest template may reach, whatever lines and paragraphs it is set in, cut down to where enough
of some template's words stand close together: a bound that no confirmed place misses.  A block,
case-folded and reduced to words, is compressed alone and with each of these templates as a
zstandard raw dictionary.  What a dictionary saves says how much of the block its template
already holds, and the templates are ranked by it.

Winners are confirmed in that order by their exact wording.  ``CONFIRM`` of a template's words have
to stand in order in a stretch that is not longer than the words allow, the template has to save
``LEAST_SAVING`` of that stretch, and no word that tells one license from another may differ: a
version that the template names has to be there, and words of ``VARIANT`` have to be in both or in
neither.  So version 2 is never taken for 3, and no Lesser license for the plain one.  A confirmed
stretch is ranked once more by itself, so that a template that does well elsewhere in the block
doesn't take a place that is another's.  Equal savings go to the longer wording, then by name.
What is taken leaves the block, and what is left is scanned again until nothing is confirmed.

Texts without a cue never leave the JVM; nothing is shuffled.  Templates are a small fixed table.

Defined results: a null or empty text has no block; repeated rows get equal results, a null doc_id
as any other; a license that stands in a text twice is reported twice, on one line as well; of a
very long text only the stretches around cues are looked at; an empty table gives none; extra
columns are not looked at.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship_package

CUE = r"(?i)licen[cs]e|copyright|warrant|redistribut|permission is hereby|public domain|spdx|creative commons|\bcc[ -]by\b"
CONFIRM, LEAST_SAVING, LEVEL = 0.8, 0.15, 19
#: Words that tell one license from another of nearly the same wording.
VARIANT = frozenset("lesser library affero later neither endorse nc nd sa noncommercial noderivatives sharealike".split())

#: Wording of public license notices.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "LGPL-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-2-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-long": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}

TEMPLATES |= {f"CC-{kind}-{version}": f"Licensed under CC {kind} {version}." for kind in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND") for version in ("3.0", "4.0")}
#: Identifiers of the public list of licenses.
IDENTIFIERS = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "BSD-2-Clause BSD-3-Clause ISC MPL-2.0 Zlib CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense EPL-2.0 BSL-1.0 0BSD"
).split()
TEMPLATES |= {f"SPDX {name}": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS}


WORD = re.compile(r"[^\W_]+(?:[.\-+'][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts(have: Iterable[str]) -> set[str]:
    return {part for word in have for part in word.split("-")}


def refuted(want: list[str], have: list[str]) -> bool:
    """Whether a version that ``want`` names is missing, or a word of ``VARIANT`` is in one alone."""
    a, b = parts(want), parts(have)
    return bool((a ^ b) & VARIANT) or any(any(map(str.isdigit, word)) for word in a - b)


def blocks(text: str | None, reach: int) -> list[tuple[list[str], list[bool]]]:
    """(words, which of them a cue touches) of each candidate block, in order."""
    text = text or ""
    cues = [m.span() for m in re.finditer(CUE, text)]
    if not cues:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    marked, k = [False] * len(spans), 0
    for first, last in cues:
        while k < len(spans) and spans[k][1] <= first:
            k += 1
        at = k
        while at < len(spans) and spans[at][0] < last:
            marked[at] = True
            at += 1
    ranges: list[list[int]] = []
    for at in (i for i, m in enumerate(marked) if m):
        low, high = max(0, at - reach), min(len(spans), at + reach + 1)
        if ranges and low <= ranges[-1][1]:
            ranges[-1][1] = high
        else:
            ranges.append([low, high])
    return [([text[i:j].lower() for i, j in spans[low:high]], marked[low:high]) for low, high in ranges]


def aligned(want: list[str], have: list[str], span: int) -> tuple[int, int, int] | None:
    """(first, last, words in common in order) of the best confirmed stretch of ``have``, or None.

    Exact: the longest common subsequence, a bit for each word of ``want``, of every stretch of
    at most ``span`` words.
    """
    bits: dict[str, int] = {}
    for k, word in enumerate(want):
        bits[word] = bits.get(word, 0) | 1 << k
    of, n = [bits.get(word, 0) for word in have], len(want)
    full, best = (1 << n) - 1, None
    for first in range(len(have)):
        if not of[first]:
            continue
        row = full
        for last in range(first + 1, min(len(have), first + span) + 1):
            if not of[last - 1]:
                continue
            hit = row & of[last - 1]
            row = ((row + hit) | (row - hit)) & full
            same = n - row.bit_count()
            if same >= CONFIRM * max(n, last - first) - 1e-9 and (best is None or 3 * same - last + first > best[0]):
                best = 3 * same - last + first, first, last, same
    return best and best[1:]


@dataclass
class Scanner:
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))

    def __post_init__(self):
        options = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **options)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        self.words = {name: found for name, text in self.templates.items() if (found := words(text))}
        self.given, self.need, self.span = {}, {}, {}
        for name, want in self.words.items():
            raw = zstandard.ZstdCompressionDict(" ".join(want).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(dict_data=raw, compression_params=params)
            # a confirmed stretch has so many words in common, and so many words at most
            self.need[name] = math.ceil(CONFIRM * len(want) - 1e-9)
            self.span[name] = math.floor(len(want) / CONFIRM + 1e-9)
        self.bags = {name: Counter(want) for name, want in self.words.items()}
        self.reach = max(self.span.values(), default=0)
        self.memo: dict[tuple, tuple | None] = {}

    def sizes(self, stretch: list[str], names: Iterable[str]) -> tuple[int, dict[str, int]]:
        """Bytes of a stretch compressed alone, and with each template given."""
        raw = " ".join(stretch).encode()
        return len(self.alone.compress(raw)), {name: len(self.given[name].compress(raw)) for name in names}

    def ranked(self, stretch: list[str], names: Iterable[str]) -> list[str]:
        """Templates by what they save of a stretch, those that save nothing left out."""
        alone, given = self.sizes(stretch, names)
        return [name for size, _, name in sorted((given[n], -len(self.words[n]), n) for n in given) if size < alone]

    def confirm(self, have: list[str], name: str) -> tuple[int, int, int, float, float] | None:
        """(first, last, words in common, share, saving) of the best confirmed stretch, or None."""
        key = (name, *have)
        if key not in self.memo:
            if len(self.memo) > 4_000:
                self.memo.clear()
            self.memo[key], want = None, self.words[name]
            if best := aligned(want, have, self.span[name]):
                first, last, same = best
                stretch = have[first:last]
                alone, given = self.sizes(stretch, [name])
                saving = 1 - given[name] / alone
                if saving >= LEAST_SAVING and not refuted(want, stretch):
                    self.memo[key] = first, last, same, same / max(len(want), last - first), saving
        return self.memo[key]

    def windows(self, have: list[str], name: str) -> list[int]:
        """Starts of windows that hold enough of a template's words, in any order."""
        bag, need, span = self.bags[name], self.need[name], self.span[name]
        free, common, out = dict(bag), 0, []
        for end in range(len(have) + span - 1):
            if end < len(have) and have[end] in free:
                free[have[end]] -= 1
                common += free[have[end]] >= 0
            start = end - span + 1
            if 0 <= start < len(have):
                if common >= need:
                    out.append(start)
                if have[start] in free:
                    common -= free[have[start]] >= 0
                    free[have[start]] += 1
        return out

    def places(self, have: list[str], name: str) -> list[tuple[int, int]]:
        """Confirmed places of one template, without overlaps."""
        out, span, done = [], self.span[name], 0
        for start in self.windows(have, name):
            parts = [(start, min(start + 2 * span, len(have)))] if start >= done else []
            while parts:
                low, high = parts.pop()
                hit = self.confirm(have[low:high], name) if high - low >= self.need[name] else None
                if hit:
                    first, last = low + hit[0], low + hit[1]
                    out.append((first, last))
                    done = max(done, last)
                    parts.append((low, first))
        return out

    def candidates(self, have: list[str], marked: list[bool]) -> list[tuple[int, int, list[str]]]:
        """(first, last, templates) of blocks where templates can stand, apart from each other."""
        here, ranges = Counter(have), []
        for name, bag in self.bags.items():
            if sum(min(n, here[w]) for w, n in bag.items()) < self.need[name]:
                continue
            for start in self.windows(have, name):
                last = min(start + self.span[name], len(have))
                if any(marked[start:last]):
                    ranges.append((start, last, name))
        out: list[tuple[int, int, set[str]]] = []
        for first, last, name in sorted(ranges):
            if out and first < out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], last), out[-1][2] | {name}
            else:
                out.append((first, last, {name}))
        return [(first, last, sorted(names)) for first, last, names in out]

    def found(self, have: list[str], marked: list[bool]) -> list[tuple]:
        """(first, last, template, saving, share, differing words, differences), in order."""
        out = []
        for low, high, names in self.candidates(have, marked):
            taken = []
            for name in self.ranked(have[low:high], names):
                for first, last in self.places(have[low:high], name):
                    if any(marked[low + first : low + last]):
                        taken.append(self.best(have, marked, low + first, low + last, names))
                if taken:
                    break
            out += taken
            if taken:
                edges = [low, *(x for place in sorted(taken) for x in place[:2]), high]
                for first, last in zip(edges[::2], edges[1::2]):
                    out += [(first + f[0], first + f[1], *f[2:]) for f in self.found(have[first:last], marked[first:last])]
        return sorted(out)

    def best(self, have: list[str], marked: list[bool], first: int, last: int, names: list[str]) -> tuple:
        """The confirmed template that saves most of a stretch, with its differences."""
        for name in self.ranked(have[first:last], names):
            hit = self.confirm(have[first:last], name)
            if hit and any(marked[first + hit[0] : first + hit[1]]):
                want, stretch = self.words[name], have[first + hit[0] : first + hit[1]]
                notes = []
                for op, a, b, c, d in difflib.SequenceMatcher(None, want, stretch, autojunk=False).get_opcodes():
                    if op != "equal":
                        notes.append(f"-{' '.join(want[a:b])} +{' '.join(stretch[c:d])}")
                return first + hit[0], first + hit[1], name, hit[4], hit[3], len(want) + len(stretch) - 2 * hit[2], notes
        raise AssertionError("a confirmed stretch has a template")

    def block(self, block: str) -> tuple[str, float, float, int, list[str]] | None:
        """(template, saving, share, differing words, differences) of the first place in a text, or None."""
        return next(iter(self.scan(block)[1]), None)

    def scan(self, text: str | None) -> tuple[int, list[tuple]]:
        found = blocks(text, self.reach)
        return len(found), [f[2:] for b in found for f in self.found(*b)]


_SCHEMA = "doc_id long, n_blocks long, matches array<struct<license:string,saving:double,share:double,n_different:int,differences:array<string>>>"
_MATCH = pa.list_(pa.struct([("license", pa.string()), ("saving", pa.float64()), ("share", pa.float64()), ("n_different", pa.int32()), ("differences", pa.list_(pa.string()))]))
_SCANNER: dict[tuple, Scanner] = {}


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_blocks, matches) of each row of ``docs``."""
    ship_package(docs.sparkSession)
    table = dict(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(sorted(table.items()))
        if key not in _SCANNER:
            _SCANNER[key] = Scanner(table)
        scanner = _SCANNER[key]
        for batch in batches:
            n, matches = [], []
            for value in batch.column(1):
                count, found = scanner.scan(value.as_py())
                n.append(count)
                matches.append([dict(zip(("license", "saving", "share", "n_different", "differences"), m)) for m in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(matches, _MATCH)], ["doc_id", "n_blocks", "matches"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(CUE), text).alias("text")).mapInArrow(run, _SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """Rows of op5: one per document, with the licenses confirmed in it."""
    names = F.array_join(F.array_sort(F.transform("matches", lambda m: m["license"])), ",")
    different = F.aggregate("matches", F.lit(0).cast("long"), lambda t, m: t + m["n_different"])
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_blocks", F.size("matches").cast("long").alias("n_licenses"), names.alias("licenses"), different.alias("n_different_words"))
