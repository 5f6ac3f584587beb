"""License scan by conditional compression.

A text is cut into sentences (and headings); runs of sentences with words of
licensing, one of them telling, are candidate blocks.  A block is compressed with
zstandard on its own and once with each template (all wordings of one license) as raw
content to start from; what a template takes off the size ranks it.  Every template
whose rank is close to the best one is then confirmed or not by the exact difference
of the wordings: the stretch of the block that one of its wordings holds in the same
order, against the words in that stretch which differ on either side.  Words that
tell licenses apart must agree: a statement ("licensed under ...") must hold the whole
name with its version, and no differing word may belong to another license's name.
The least difference wins; a statement that names several licenses confirms them all.

The wordings are the short licenses in full, the notices that the long ones ask for,
and statements made from the licenses' names by rule; ``templates_from`` adds whole
texts from a folder.  The scan is a map over the rows: no shuffle, no state; equal
blocks are scanned once a task.

Defined results: null and empty texts have no block; a block above ``MAX_BLOCK``
words is scanned in overlapping pieces of that size; ties between templates go to one that
another block of the text shows, else to the first name; several blocks of one license count as blocks but name it once; equal
rows get equal results; only doc_id and text are read.
"""

from __future__ import annotations

import difflib
import re
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import tune

# Sentences of public licenses that several of them share.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""


def _gnu(name: str, version: str) -> str:
    return _GNU.format(name=name, version=version, colon=":")


# Texts and notices by license.
TEXTS = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY],
    "AGPL-3.0": [_gnu("Affero General Public License", "3")],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
    ],
    "BSD-2-Clause": [f"{_BSD_HEAD} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_WARRANTY}"],
    "BSL-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": [
        """Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence."""
    ],
    "GPL-2.0": [_gnu("General Public License", "2")],
    "GPL-3.0": [_gnu("General Public License", "3")],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY],
    "LGPL-2.1": [_gnu("Lesser General Public License", "2.1")],
    "LGPL-3.0": [_gnu("Lesser General Public License", "3")],
    "MIT": [f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": [
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
        "All rights reserved.",
        "Copyright holder. All rights reserved.",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
    ],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
    ],
}
# Names by which statements call a license (compared without case, punctuation, "the" and "version").
NAMES = {
    "0BSD": ["0BSD", "Zero-Clause BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License 3", "GNU AGPL 3", "AGPL 3", "AGPLv3"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0", "Apache Software License 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause"],
    "BSL-1.0": ["Boost Software License 1.0", "BSL-1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
    "GPL-2.0": ["GNU General Public License 2", "GNU GPL 2", "GPL 2", "GPLv2", "GPL 2.0"],
    "GPL-3.0": ["GNU General Public License 3", "GNU GPL 3", "GPL 3", "GPLv3", "GPL 3.0"],
    "ISC": ["ISC License", "ISC"],
    "LGPL-2.1": ["GNU Lesser General Public License 2.1", "GNU LGPL 2.1", "LGPL 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License 3", "GNU LGPL 3", "LGPL 3", "LGPLv3"],
    "MIT": ["MIT License", "MIT", "Expat License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "Zlib": ["zlib License"],
}
# The parts of the licenses CC BY and their long names.
_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _kinds in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _long = "-".join(_CC[k] for k in _kinds.split("-"))
    NAMES[f"CC-{_kinds}-4.0"] = [f"CC {_kinds} 4.0", f"CC-{_kinds}-4.0", f"Creative Commons {_long} 4.0 International License", f"Creative Commons {_long} 4.0", f"CC {_long} 4.0"]
#: What comes before a name in a statement.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "Published under", "Available under", "Made available under the terms of", "Under the terms of", "This work is licensed under", "This software is released under", "This project is licensed under", "Dedicated to the public domain under", "License:", "")

STRONG = re.compile(r"licen[cs]e|licensed|copyright|\(c\)|©|all rights reserved|public domain|permission is|redistribut|creative commons|free software|unencumbered|\bas[ -]is\b|prior written permission|no part of this|this publication", re.I)
#: Short names, in capitals only ("mit" is a common word of German).
NAMED = re.compile(r"\b(?:MIT|0BSD|BSD|ISC|Apache|[AL]?GPL|MPL|EPL|EUPL|BSL|WTFPL|CC0|CC[ -](?:BY|Attribution)|zlib|Unlicense)\b|\b(?:[AL]?GPL)v\d")
WEAK = re.compile(STRONG.pattern + r"|warrant|liab|damages|merchantab|conditions|provided that|the software|this software|source code|disclaimer|endorse|version \d|at your option|<https?:|misrepresent", re.I)
MAX_BLOCK = 400
#: Least part of its size that a block loses with the right template; how far a rank may lie behind the best and still be confirmed.
MIN_GAIN, CLOSE = 0.15, 0.2
#: Most words of a stretch that may differ, and least words of a text (not a statement) that a stretch must hold.
MAX_DIFFERENT, LEAST_WORDS = 0.2, 12

_WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_CUT = re.compile(r"(?<!\b[A-Z])(?<!\bv)(?<!\bInc)(?<!\bLtd)(?<!\bCo)[.!?][\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9©*])|:\s*\n|\n\s*\n|\n(?=\s*(?:[A-Z©*#]|\d+\.|\([a-z]\)))")
_HOLDER = re.compile(r"(?:copyright|©|\(c\))\s*(?:copyright|©|\(c\))?\s*\d{4}[\w.,&<>@ -]{0,80}?(?=\.?\s*(?:all rights|redistrib|permission|this |the |licen|$))|copyright\s[\w.,&<>@ -]{0,60}?(?=[.,]?\s*all rights)", re.I)


def word_list(text: str) -> list[str]:
    """Words in small letters; articles and "version" do not tell wordings apart."""
    found = _WORDS.findall(text.lower().replace("licence", "license"))
    found = [w[1:] if re.fullmatch(r"v\d[\d.]*", w) else w for w in found]
    return [w for w in found if w not in ("the", "a", "an", "version", "v")]


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _CUT.split(text) if s and s.strip()]


def blocks(text: str | None) -> list[str]:
    """Candidate blocks: runs of sentences with words of licensing, at least one of them a telling one."""
    telling = lambda s: STRONG.search(s) or NAMED.search(s)
    if not text or not telling(text):
        return []
    out, run = [], []
    for s in [*sentences(text), ""]:
        if s and (WEAK.search(s) or NAMED.search(s) or run and len(s.split()) < 3):
            run.append(s)
        elif run:
            if any(map(telling, run)):
                out.append(" ".join(" ".join(r.split()) for r in run))
            run = []
    cut = []
    for b in out:
        w = b.split()
        step = MAX_BLOCK // 2
        cut += [" ".join(w[i : i + MAX_BLOCK]) for i in range(0, max(1, len(w) - step), step)]
    return cut


def templates_from(folder: str) -> dict[str, list[str]]:
    """Whole license texts, one per file, named by the files: ``scan_licenses(docs, extra=templates_from(...))``."""
    return {p.name: [p.read_text(encoding="utf-8", errors="replace")] for p in sorted(Path(folder).iterdir()) if p.is_file()}


class Scanner:
    def __init__(self, extra: dict[str, list[str]] | None = None):
        self.names = sorted({*TEXTS, *NAMES, *(extra or {})})
        self.texts = [[word_list(w) for w in [*TEXTS.get(n, []), *(extra or {}).get(n, [])]] for n in self.names]
        self.called = [[word_list(c) for c in NAMES.get(n, [])] for n in self.names]
        self.openings = [word_list(o) for o in OPENINGS]
        # Words that only names of licenses hold; a differing one among them means another license.
        self.telling = {w for c in self.called for name in c for w in name} - {"license", "software", "public", "general", "international", "new", "do", "what", "you", "want", "to", "union", "universal", "zero", "fuck"}
        self.plain = zstandard.ZstdCompressor(level=9)
        self.primed = []
        for n in self.names:
            raw = "\n".join([*TEXTS.get(n, []), *(extra or {}).get(n, []), *(f"{o} the {c}." for o in OPENINGS for c in NAMES.get(n, []))])
            start = zstandard.ZstdCompressionDict(raw.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            start.precompute_compress(level=9)
            self.primed.append(zstandard.ZstdCompressor(dict_data=start))
        self.known: dict[str, list[tuple]] = {}

    def gains(self, block: str) -> list[tuple[float, int]]:
        """(share of the size that a template takes off, template), best first."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        ranked = sorted((-(alone - len(c.compress(raw))) / alone, i) for i, c in enumerate(self.primed))
        return [(-g, i) for g, i in ranked]

    def names_in(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(from, to, license) of the names in a block, longest first, without overlaps."""
        found = []
        for i, called in enumerate(self.called):
            for name in called:
                for a in range(len(words) - len(name) + 1):
                    if words[a : a + len(name)] == name:
                        found.append((a, a + len(name), i))
        out: list[tuple[int, int, int]] = []
        for a, b, i in sorted(found, key=lambda f: (f[0] - f[1], f[0], f[2])):
            if all(b <= c or a >= d for c, d, _ in out):
                out.append((a, b, i))
        return sorted(out)

    def statement(self, words: list[str], i: int) -> tuple[float, str] | None:
        """Difference of a statement that names license ``i``: an opening, then one or several names."""
        held = self.names_in(words)
        own = [n for n in held if n[2] == i]
        if not own or len(words) > 60:
            return None
        first = own[0]
        start, names = first[0], [first]
        for n in reversed([n for n in held if n[1] <= first[0]]):  # "the MIT or Apache License": the names before belong to it
            if all(w in ("or", "and", "license", "at", "your", "option") for w in words[n[1] : start]):
                start, names = n[0], [n, *names]
        best = None
        for opening in self.openings:
            before = words[max(0, start - len(opening)) : start]
            if opening and before == opening or not opening and len(words) <= first[1] - start + 2:
                kept = len(opening) + first[1] - start
                best = max(best or 0, kept)
        if best is None:
            return None
        follows = words[first[1] : first[1] + 1]
        if follows and re.fullmatch(r"\d+(\.\d+)*", follows[0]):
            return None  # another version than the name's
        said = [w for a, b, _ in names for w in words[a:b]]
        missing = [w for w in words[start : first[1]] if w not in said and w not in ("or", "and")]
        return len(missing) / best, " ".join(missing)

    def difference(self, words: list[str], i: int) -> tuple[float, str] | None:
        """Least (share of differing words, differing words of the block) over the texts of template ``i``; None if none fits."""
        best = None
        for text in self.texts[i]:
            m = [b for b in difflib.SequenceMatcher(None, text, words, autojunk=False).get_matching_blocks() if b.size >= min(3, len(text))]
            top = (0, 0, 0)
            for x in range(len(m)):  # the stretch with the most words in common after what differs
                held = 0
                for y in range(x, len(m)):
                    held += m[y].size
                    span = max(m[y].a + m[y].size - m[x].a, m[y].b + m[y].size - m[x].b)
                    if 2 * held - span > top[0]:
                        top = (2 * held - span, x, y)
            if not top[0]:
                continue
            _, x, y = top
            held = sum(b.size for b in m[x : y + 1])
            of_text, of_block = m[y].a + m[y].size - m[x].a, m[y].b + m[y].size - m[x].b
            share = 1 - held / max(of_text, of_block)
            missing = [w for b, c in zip(m[x:y], m[x + 1 : y + 1]) for w in words[b.b + b.size : c.b]]
            gone = [w for b, c in zip(m[x:y], m[x + 1 : y + 1]) for w in text[b.a + b.size : c.a]]
            if held < min(LEAST_WORDS, len(text)) or share > MAX_DIFFERENT or self.telling & {*missing, *gone} - {w for w in missing if w in gone}:
                continue
            # The rest of the block that another text may hold ranks close ones: less left over is better.
            rest = 1 - held / max(len(words), 1)
            if best is None or (share, rest) < (best[0], best[2]):
                best = (share, " ".join(missing), rest)
        return best

    def scan(self, block: str) -> list[tuple]:
        """(license or None, gain, difference, differing words, licenses that fit as well) per license confirmed in a block."""
        if block in self.known:
            return self.known[block]
        if len(self.known) > 50_000:
            self.known.clear()
        ranked = self.gains(block)
        floor = max(MIN_GAIN, ranked[0][0] - CLOSE)
        words = word_list(_HOLDER.sub("copyright holder", block))
        stated, worded = [], []
        for gain, i in ranked:
            if gain < floor:
                break
            if s := self.statement(words, i):
                if s[0] <= MAX_DIFFERENT:
                    stated.append((self.names[i], gain, *s))
            if d := self.difference(words, i):
                worded.append((d[2] + d[0], self.names[i], gain, d[0], d[1]))
        out = stated
        if worded:
            rank = min(worded)[0]
            best = [w[1:] for w in sorted(worded) if w[0] <= rank + 1e-9]
            # A reservation of rights beside a license is no license of its own.
            if not stated:
                out = [(best[0][0], *best[0][1:], tuple(w[0] for w in best))]
            elif best[0][0] in {s[0] for s in stated}:
                out = [s for s in stated if s[0] != best[0][0]] + best[:1]
        out = [(*s, (s[0],)) if len(s) == 4 else s for s in out]
        self.known[block] = out or [(None, ranked[0][0], 1.0, "", ())]
        return self.known[block]


def scan_text(scanner: Scanner, text: str | None) -> list[list[tuple]]:
    """What ``Scanner.scan`` finds in each block of a text; of licenses that fit a block alike, one that another block shows goes first."""
    found = [scanner.scan(b) for b in blocks(text)]
    sure = {f[0] for block in found for f in block if len(f[4]) == 1}
    return [[(next((n for n in f[4] if n in sure), f[0]), *f[1:]) for f in block] for block in found]


def scan_licenses(docs: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row: doc_id, n_blocks, n_confirmed (blocks), licenses (sorted names), gain and difference of the best block, missing words."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_blocks", pa.int64()), ("n_confirmed", pa.int64()), ("licenses", pa.list_(pa.string())), ("gain", pa.float64()), ("difference", pa.float64()), ("missing", pa.string())])

    def run(batches):
        scanner = Scanner(extra)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = scan_text(scanner, text)
                good = sorted((s for found in own for s in found if s[0]), key=lambda s: (s[2], -s[1], s[0]))
                top = good[0] if good else (None, max((s[1] for found in own for s in found), default=0.0), 1.0, "")
                out.append((doc_id, len(own), sum(1 for found in own if found[0][0]), sorted({s[0] for s in good}), top[1], top[2], top[3]))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_blocks long, n_confirmed long, licenses array<string>, gain double, difference double, missing string")
