"""Licence scans: compression ranks, alignment confirms."""

import pytest

from pulseframe.llm import licenses

FREE = "This {} is free software{} you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
FOUND = {
    FREE.format("program", ";", "GNU General Public License", ";", "2"): "GPL-2.0-or-later",
    FREE.format("program", ":", "GNU General Public License", ",", "3"): "GPL-3.0-or-later",
    FREE.format("library", ";", "GNU Lesser General Public License", ";", "2.1"): "LGPL-2.1-or-later",
    FREE.format("program", ":", "GNU Affero General Public License", ",", "3"): "AGPL-3.0-or-later",
    "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0-only",
    "To the extent possible under law, Jane Doe the author has waived all copyright and related or neighboring rights to this work.": "CC0-1.0",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0",
    "Released under the MIT License.": "MIT",
}


@pytest.fixture(scope="module")
def templates():
    return licenses.Templates(licenses.STATEMENTS)


@pytest.mark.parametrize("text,name", FOUND.items())
def test_usual_notices(templates, text, name):
    for before, after in (("", ""), ("some words before it all " * 9, " and more after " * 30)):
        assert [f[1] for f in templates.find(licenses.wording(before + text + after), 0.8)] == [name]


def test_overlapping_wordings_are_decided_by_what_they_save(templates):
    """A full text holds the words of shorter templates: the one that saves most is confirmed, and the others aren't aligned there."""
    full = next(s for n, s, _ in licenses.STATEMENTS if n == "BSD-3-Clause" and len(s) > 900)
    words = licenses.wording("intro " * 5 + full)
    ranked = templates.rank(words, 0.8)
    assert len({i for *_, i, _ in ranked}) >= 2 and ranked == sorted(ranked)
    names = [licenses.STATEMENTS[i] for *_, i, _ in ranked]
    assert names[0][0] == "BSD-3-Clause" and len(names[0][1]) > 900
    asked, inner = [], templates.align
    templates.align = lambda w, at, i, t: asked.append(i) or inner(w, at, i, t)
    try:
        found = templates.find(words, 0.8)
    finally:
        del templates.align
    assert [f[1] for f in found] == ["BSD-3-Clause"] and len(found[0][5]) == 0 and found[0][4] == 1.0
    assert len(asked) < len(ranked)


def test_all_notices_of_a_text_whatever_their_rank(templates):
    text = "\n\n".join(f"part {k}\n{t}" for k, t in enumerate(FOUND))
    assert [f[1] for f in templates.find(licenses.wording(text), 0.8)] == list(FOUND.values())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0] * (len(b) + 1)
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(row[k], last[k + 1])
    return row[-1]


def test_similarity_missing_and_added(templates):
    """Of a notice with words taken out and put in: the common subsequence, and what is not in it."""
    own = licenses.wording(FREE.format("program", ";", "GNU General Public License", ";", "2"))
    for out, put in (([], []), ([3], []), ([5, 9], [(12, "really")]), ([], [(4, "very"), (20, "indeed")]), ([1, 7, 30], [(15, "x")])):
        words = [w for k, w in enumerate(own) if k not in out]
        for at, w in put:
            words.insert(at, w)
        ((_, name, plain, given, similarity, missing, added),) = templates.find(["so"] * 20 + words + ["end"] * 20, 0.8)
        same = lcs(own, words)
        assert name == "GPL-2.0-or-later" and given < plain
        assert similarity == pytest.approx(same / (len(own) + len(words) - same))
        assert sorted(missing) == sorted(own[k] for k in out) and added == [w for _, w in put]
