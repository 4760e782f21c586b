"""License scans by conditional compression (operator 3).

A notice is a place of a document where a licence template's statement stands:
at least ``threshold`` of the statement's words in order, words in between
counted against them, and none missing that names the licence (its name, its
version).  Around every occurrence of a template's naming word lies a candidate
block, where the statement would stand word for word, if enough of the
template's words are as near as the longest admissible wording can reach.  Each block is compressed with zstandard plainly
and with its template as a raw dictionary, under the same parameters, and the
blocks of a document are ranked by how much smaller the dictionary made them.
In that order they are confirmed: by the exact best alignment of the template's
words around the naming word, unless a better-ranked notice already stands
there.  So of wordings that overlap the one that saves most stands, and all that
don't overlap it do; neither the length of a text or line nor line breaks,
comment signs or other notices nearby matter.

Native expressions drop documents that lack every template's naming words; the
others reach Python whole, and rows stay where they are (no shuffle).

Result: one row per document and notice, ``block`` being the number of its
first line; sizes are those of the place.  Defined cases: null and blank texts
have no notices; repeated rows are scanned one by one; of blocks that
save as much the one of fewer bytes ranks first, then the first template, then the first place;
an empty table gives no notices; no other column is read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store, _words

#: Public licence texts, in their usual wording.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
)
_FREE = "This {} is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
#: Fixed values: (licence, statement or full text, words that must stand as they are).
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "by 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "by-nc 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "by-sa 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "attribution-noncommercial 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "attribution-sharealike 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "hereby charge"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("GPL-2.0-or-later", _FREE.format("program", "GNU General Public License", "2"), "gnu general 2"),
    ("GPL-3.0-or-later", _FREE.format("program", "GNU General Public License", "3"), "gnu general 3"),
    ("LGPL-2.1-or-later", _FREE.format("library", "GNU Lesser General Public License", "2.1"), "gnu lesser 2.1"),
    ("LGPL-3.0-or-later", _FREE.format("library", "GNU Lesser General Public License", "3"), "gnu lesser 3"),
    ("AGPL-3.0-or-later", _FREE.format("program", "GNU Affero General Public License", "3"), "gnu affero 3"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "attribution 3.0"),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "attribution-sharealike 3.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived neighboring"),
    *((name, f"SPDX-License-Identifier: {name}", f"spdx-license-identifier {name.lower()}") for name in _SPDX.split()),
    ("MIT", _MIT, "hereby charge noninfringement"),
    ("BSD-2-Clause", _BSD + _AS_IS, "redistribution reproduce disclaimed"),
    ("BSD-3-Clause", _BSD + _NAMES + _AS_IS, "redistribution reproduce endorse disclaimed"),
    ("ISC", _ISC, "fee tortious"),
    ("Zlib", _ZLIB, "freely misrepresented"),
)
_WORD = re.compile(r"[^\W_]+(?:(?:[.]|-(?:[^\S\n]*\n[\W_]*+)?)[^\W_]+)*")  # a word may be cut after its hyphen
_CUT = re.compile(r"\s[\W_]*")


def wording(text: str) -> list[str]:
    found = _WORD.findall(text.lower())
    return [_CUT.sub("", w) if "\n" in w else w for w in found]


class Templates:
    """Statements, where their wording stands in a text, and their compressors.

    ``best`` is accepted for callers' sake: no template is left out by its rank.
    """

    def __init__(self, statements, best: int | None = None):
        import zstandard

        self.rows = [(name, wording(s), set(names.split())) for name, s, names in statements]
        self.bags = [Counter(own) for _, own, _ in self.rows]
        self.anchor = [next((k for k, w in enumerate(own) if w in fixed), None) for _, own, fixed in self.rows]
        # the same explicit parameters with and without a dictionary
        same = zstandard.ZstdCompressionParameters.from_level(3, source_size=1 << 12, dict_size=1 << 9, write_content_size=False)
        make = lambda **k: zstandard.ZstdCompressor(compression_params=same, **k)
        self.plain = make()
        self.given = [make(dict_data=zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, own, _ in self.rows]

    def align(self, words: list[str], at: int, i: int, threshold: float):
        """Best (score, places, own places) of template ``i`` near word ``at``, if it holds; the score is words covered less ``threshold`` times words added."""
        _, own, fixed = self.rows[i]
        anchor, span = self.anchor[i], int(len(own) / threshold + 1e-9)
        begin = at - anchor if anchor is not None else at
        if begin >= 0 and words[begin : begin + len(own)] == own:  # word for word
            return float(len(own)), list(range(begin, begin + len(own))), list(range(len(own)))
        low, high = max(0, at - span), min(len(words), at + span + 1)
        need = threshold * len(own) - 1e-9
        # words missing, and words added, up to any place: no more than the threshold allows altogether
        short, long = len(own) - need, (len(own) - need) / threshold
        have, common = Counter(words[low:high]), Counter(own)
        if any(w not in have for w in fixed) or sum(min(n, have[w]) for w, n in common.items()) < need:
            return None
        places: dict[str, list[int]] = {}
        for k, w in enumerate(own):
            places.setdefault(w, []).append(k)
        # A fixed word between two places can't be skipped: count those before each place.
        before = [0]
        for w in own:
            before.append(before[-1] + (w in fixed))
        points, best = [], None  # (word, own place, score, previous point)
        for x in range(low, high):
            for k in places.get(words[x], ()):
                if anchor is not None and (x - at, k - anchor) != (0, 0) and (x - at) * (k - anchor) <= 0:
                    continue  # the anchor word stands at ``at``
                if anchor is not None and not -short <= (x - at) - (k - anchor) <= long:
                    continue
                score, last = (1.0, -1) if not before[k] else (-math.inf, -1)
                for j, (y, m, had, _) in enumerate(points):
                    if y < x and m < k and before[k] == before[m + 1] and had + 1 - threshold * (x - y - 1) > score:
                        score, last = had + 1 - threshold * (x - y - 1), j
                if score == -math.inf:
                    continue
                points.append((x, k, score, last))
                if before[k + 1] == before[-1] and score >= need and (best is None or score > points[best][2]):
                    best = len(points) - 1
        if best is None:
            return None
        score, chain = points[best][2], []
        while best >= 0:
            x, k, _, best = points[best]
            chain.append((x, k))
        return score, [x for x, _ in chain[::-1]], [k for _, k in chain[::-1]]

    def block(self, words: list[str], at: int, i: int, threshold: float) -> str | None:
        """The block around a naming word, if near it are enough of the template's words and all that name it."""
        _, own, fixed = self.rows[i]
        span = int(len(own) / threshold + 1e-9)
        part = words[max(0, at - span) : at + span + 1]
        have = Counter(part)
        if any(w not in have for w in fixed) or sum(min(n, have[w]) for w, n in self.bags[i].items()) < threshold * len(own) - 1e-9:
            return None
        begin = max(0, at - (self.anchor[i] or 0))
        return " ".join(words[begin : begin + len(own)])  # case, spacing and punctuation don't count

    def rank(self, words: list[str], threshold: float) -> list[tuple[int, int, int, int]]:
        """(bytes saved, bytes left, template, place of the naming word) of all candidate blocks, those that save most first; the bytes saved are negative."""
        where: dict[str, list[int]] = {}
        for x, w in enumerate(words):
            where.setdefault(w, []).append(x)
        out = []
        for i, (_, own, fixed) in enumerate(self.rows):
            if all(w in where for w in fixed):
                for at in range(len(words)) if self.anchor[i] is None else where[own[self.anchor[i]]]:
                    if (block := self.block(words, at, i, threshold)) is not None:
                        raw = block.encode()
                        given = len(self.given[i].compress(raw))
                        out.append((given - len(self.plain.compress(raw)), given, i, at))
        return sorted(out)

    def find(self, words: list[str], threshold: float) -> list[tuple]:
        """(first word, licence, plain size, size given the template, similarity, missing words, added words) of every notice, by place; sizes are those of the place."""
        kept: list[tuple[int, int, tuple]] = []
        for *_, i, at in self.rank(words, threshold):
            if any(a <= at < b for a, b, _ in kept) or (got := self.align(words, at, i, threshold)) is None:
                continue
            _, places, own_at = got
            a, b = places[0], places[-1] + 1
            if any(a < d and c < b for c, d, _ in kept):
                continue
            raw, (name, own, _) = " ".join(words[a:b]).encode(), self.rows[i]
            missing = [w for k, w in enumerate(own) if k not in set(own_at)]
            added = [words[x] for x in range(a, b) if x not in set(places)]
            kept.append((a, b, (a, name, len(self.plain.compress(raw)), len(self.given[i].compress(raw)), len(places) / (len(own) + len(added)), missing, added)))
        return [found for *_, found in sorted(kept)]

    def scan(self, block: str, threshold: float):
        """(licence, plain size, size given the template, similarity, missing words, added words) of the first notice, or None."""
        found = self.find(wording(block), threshold)
        return found[0][1:] if found else None


def scan(docs: DataFrame, statements=STATEMENTS, threshold: float = 0.8, best: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    names = sorted({tuple(sorted(set(n.replace("-", " ").split()))) for _, _, n in statements})  # a word may be cut after its hyphen
    speaks = lambda t: reduce(or_, (reduce(and_, (F.contains(t, F.lit(w)) for w in ws), F.lit(True)) for ws in names), F.lit(False))
    # in an array, so that texts are put in lower case once
    rows = docs.filter(F.exists(F.array(F.lower(F.col(text_col))), speaks)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        templates = Templates(statements, best)
        for b in _words.slices(batches, "text", 2 << 20):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text.lower()
                found = templates.find(wording(text), threshold)
                starts = [m.start() for m in _WORD.finditer(text)] if found else []
                out += [(doc, text.count("\n", 0, starts[f[0]]), *f[1:]) for f in found]
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "block", "license", "plain_bytes", "given_bytes", "similarity", "missing", "added"])

    return rows.mapInArrow(run, "doc_id long, block int, license string, plain_bytes int, given_bytes int, similarity double, missing array<string>, added array<string>")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(_store.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumns({"similarity": F.round("similarity", 6), "missing": F.concat_ws(" ", "missing"), "added": F.concat_ws(" ", "added")})
