"""License scan by conditional compression.

Candidate blocks are the words around each mention of licensing, as many both ways as the longest
template has with its changes, over line ends and comment signs. Mentions are the usual words and,
of every template, enough of its own words that one is left in any run within the limit. A block is
compressed in windows, plain and with each template as raw zstandard dictionary. A template whose dictionary reduces the window by at least ``LEAST_SHARE``
of what it reduces the template itself (runs within the limit reach half as much again; templates
of at most ``SHORT`` words need not) is confirmed by wording: the fewest word changes (insert,
delete, replace) that turn the template into a run of the window's words, after lower-casing and
dropping punctuation at word ends, at most ``most_changes`` of the template's words. Runs are ranked by the bytes that their template's dictionary saves on them; of overlapping
runs the first in rank stays (ties: fewer changes, then the longer template, then place and name).

Words that tell licenses apart (names, variants, every word with a digit) must stand unchanged, and
with nothing put between two that are neighbours. A run that is within the limit but for such a word
is a row with license ``unknown`` (a license line that names none of the templates), as is an SPDX
identifier without template.

Null and empty texts have no blocks. Every input row is scanned by itself, so null and
repeated ids give rows of their own; a text without a match gives none. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame

from flowbeam.llm.frames import map_rows

# Public license notices as they are commonly worded.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    # short forms beside the above, so that a near wording is not given to another license
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD": "Released under the BSD License.",
    "ISC": "Released under the ISC License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
    "International License.",
    "CC-BY-NC-ND-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
    "International License.",
    # header notices as the licenses themselves give them
    **{f"{name}-header": f"{what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {kind}General "
       f"Public License as published by the Free Software Foundation{sep2} either version {version} of the License, or (at your "
       "option) any later version."
       for name, what, sep, kind, sep2, version in (
           ("GPL-2.0", "This program", ";", "", ";", "2"), ("GPL-3.0", "This program", ":", "", ",", "3"),
           ("LGPL-2.1", "This library", ";", "Lesser ", ";", "2.1"), ("LGPL-3.0", "This library", ":", "Lesser ", ",", "3"),
           ("AGPL-3.0", "This program", ":", "Affero ", ",", "3"))},
    "GPL-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License version 2 as published by the Free Software Foundation.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
    "and accompanying documentation covered by this license",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0-dedication": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all "
    "of his or her rights to the work worldwide under copyright law",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
    "2.0 which is available at",
    "OFL-1.1-header": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    # titles that full texts open with
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004",
    "MPL-2.0-text": "Mozilla Public License Version 2.0 1. Definitions",
    "EPL-2.0-text": "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE",
    "BSL-1.0-text": "Boost Software License - Version 1.0 - August 17th, 2003",
    "OFL-1.1-text": "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    "CC0-1.0-text": "Creative Commons Legal Code CC0 1.0 Universal",
    **{f"CC-{short}-4.0-text": f"Creative Commons {long} 4.0 International Public License" for short, long in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
}
#: SPDX lines; the identifiers of an expression are looked up here too.
SPDX_LINES = {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in (
    "MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD ISC Zlib BSL-1.0 MPL-2.0 EPL-2.0 EUPL-1.2 OFL-1.1 Unlicense CC0-1.0 "
    "WTFPL Artistic-2.0 PostgreSQL CC-BY-4.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 "
    "GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later").split()}
UNKNOWN = "unknown"
_SPDX = "spdx-license-identifier"
#: Words that name a license or its variant, beside all words with a digit and those beginning with "by-" or "attribution".
NAME_WORDS = frozenset(
    "mit apache gnu general lesser affero public bsd bsd-style isc cc by creative commons mozilla eclipse boost sil open".split())
#: Share of its own reduction by which a template's dictionary must reduce a window.
LEAST_SHARE = 0.2
#: Templates of so few words are confirmed whatever they save: one changed word leaves too few bytes to tell.
SHORT = 8
#: Parts of words that a license line may hold; single words, as a notice may be wrapped between any two.
MENTIONS = ("licens", "licenc", "copyright", "redistribution", "permission", "spdx", "unencumbered")
#: A word: from its first to its last letter or digit, so quotes and comment signs are left out.
_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
_BROKEN = re.compile(r"-\r?\n[\W_]*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def is_name(word: str) -> bool:
    """Whether a template's word must stand unchanged."""
    return word in NAME_WORDS or word.startswith(("by-", "attribution")) or any(c.isdigit() for c in word)


@dataclass(frozen=True)
class Template:
    """A template's words, which of them are names, how many may change, and words of which any run holds one."""

    name: str
    words: tuple[str, ...]
    names: tuple[bool, ...]
    most: int
    anchors: frozenset[str]

    @classmethod
    def of(cls, name: str, text: str, most_changes: float) -> Template:
        words = tuple(words_of(text))
        names = tuple(map(is_name, words))
        most = math.floor(most_changes * len(words) + 1e-9)
        kept = [w for w, n in zip(words, names) if n and w not in ("general", "public", "open", "by")]
        longest = sorted(set(words), key=lambda w: (-len(w), w))
        # a name stays; of other words one more than may change, counting each as often as it is there
        anchors, held = set(kept[:1]), 0
        while not kept and longest and held <= most:
            anchors.add(longest.pop(0))
            held = sum(w in anchors for w in words)
        return cls(name, words, names, most, frozenset(anchors))


class Prepared:
    """Templates with their compressors, made once a task."""

    def __init__(self, templates: dict[str, str], most_changes: float):
        made = [Template.of(name, t, most_changes) for name, t in templates.items()]
        self.templates = [t for t in made if t.words and not (len(t.words) == 2 and t.words[0] == _SPDX)]
        self.spdx = {t.words[1]: t.name for t in made if len(t.words) == 2 and t.words[0] == _SPDX}
        self.anchors = sorted(set().union(*(t.anchors for t in self.templates)))
        self.reach = max((len(t.words) + t.most for t in self.templates), default=2)
        self.plain = _compressor(None)
        self.with_template = {t.name: _compressor(t.words) for t in self.templates}
        self.least = {t.name: LEAST_SHARE * self.reduction(t.words, t.name) for t in self.templates}

    def mentions(self, text: str) -> list[int]:
        """Where a word begins or holds a mention, or is a template's own word."""
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only: places stay
        found = []
        for word in (*MENTIONS, *self.anchors):
            at, whole = low.find(word), word not in MENTIONS
            while at >= 0:
                end = at + len(word)
                if not (whole and (low[at - 1 : at].isalnum() or low[end : end + 1].isalnum())):
                    found.append(at)
                at = low.find(word, end)
        return sorted(found)

    def reduction(self, words, name: str) -> int:
        """Bytes that the template as dictionary saves on some words."""
        data = " ".join(words).encode("utf-8", "surrogatepass")
        return len(self.plain.compress(data)) - len(self.with_template[name].compress(data))

    def candidates(self, words: list[str]) -> list[tuple[int, Template]]:
        """Templates by the bytes that they save on a window, the best first: those to be confirmed by wording."""
        data = " ".join(words).encode("utf-8", "surrogatepass")
        plain, out = len(self.plain.compress(data)), []
        for t in self.templates:
            saved = plain - len(self.with_template[t.name].compress(data))
            if len(t.words) <= SHORT or saved > 0 and saved >= self.least[t.name]:
                out.append((saved, t))
        return sorted(out, key=lambda x: (-x[0], x[1].name))


def _compressor(words) -> zstandard.ZstdCompressor:
    """Fine-grained matches from three bytes on, as blocks are short; with words as raw dictionary."""
    settings = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, write_content_size=False, write_dict_id=False)
    if words is None:
        return zstandard.ZstdCompressor(compression_params=settings)
    # small dictionaries are padded: zstandard takes raw content of eight bytes and more
    raw = zstandard.ZstdCompressionDict(" ".join(words).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=raw)


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...], most_changes: float) -> Prepared:
    return Prepared(dict(templates), most_changes)


def prepared(templates: dict[str, str], most_changes: float) -> Prepared:
    return _prepared(tuple(templates.items()), most_changes)


def candidate_blocks(text: str, reach: int, mentions: list[int]) -> list[list[tuple[int, int]]]:
    """Spans of the words within ``reach`` words of a mention, over line ends; blocks do not touch."""
    starts, ends = array("q"), array("q")
    for m in _WORD.finditer(text):
        if ends and text.startswith(("-\n", "-\r\n"), ends[-1]):  # a line ends after a hyphen in the word
            ends[-1] = m.end()
        else:
            starts.append(m.start())
            ends.append(m.end())
    runs: list[tuple[int, int]] = []
    for at in mentions:
        k = bisect_right(starts, at)
        a, b = max(k - 1 - reach, 0), min(k + reach, len(starts))
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], b)
        else:
            runs.append((a, b))
    return [list(zip(starts[a:b], ends[a:b])) for a, b in runs]


def word_changes(template: list[str], words: list[str]) -> int:
    """Fewest changes that turn the template into some run of ``words``."""
    above = [0] * (len(words) + 1)
    for i, t in enumerate(template, 1):
        row = [i]
        for j, w in enumerate(words, 1):
            row.append(min(above[j - 1] + (t != w), above[j] + 1, row[-1] + 1))
        above = row
    return min(above)


def changes_by_end(template: list[str], words: list[str]) -> list[int]:
    """Per word, the fewest changes that turn the template into some run that ends with it.

    Myers' bit vectors: a few operations on whole numbers of as many bits as the template has words.
    """
    places: dict[str, int] = {}
    for i, t in enumerate(template):
        places[t] = places.get(t, 0) | 1 << i
    full, high = (1 << len(template)) - 1, 1 << len(template) - 1
    up, down, score, out = full, 0, len(template), []
    for w in words:
        eq = places.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = (down | ~(xh | up)) & full, up & xh & full
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        out.append(score)
    return out


def run_before(template: Template, words: list[str], end: int) -> tuple[int, int] | None:
    """(changes, start) of the run before ``end`` that is the fewest changes away with all names in place.

    Of several the one nearest in length. None when none is within the limit.
    """
    t, names, n, most = template.words, template.names, len(template.words), template.most
    never = n + most + 1
    row = [0] * (n + 1)
    for j in range(1, n + 1):
        row[j] = never if names[n - j] else min(row[j - 1] + 1, never)
    best = (row[n], n, 0)
    for k in range(1, min(end, n + most) + 1):
        w, above = words[end - k], row
        row = [min(above[0] + 1, never)]
        for j in range(1, n + 1):
            at = n - j
            if t[at] == w:
                cost = above[j - 1]
            else:
                cost = never if names[at] else min(above[j - 1], row[-1]) + 1
            if not (j < n and names[at] and names[at - 1]):  # nothing between two names
                cost = min(cost, above[j] + 1)
            if t[at] == w and not names[at]:
                cost = min(cost, row[-1] + 1)
            row.append(min(cost, never))
        best = min(best, (row[n], abs(k - n), k))
    changes, _, size = best
    return (changes, end - size) if changes <= most and size else None


def spdx_identifiers(words: list[str]) -> list[tuple[int, int]]:
    """Per SPDX line, the line's word and each identifier's in its expression, exceptions left out."""
    out = []
    for i, w in enumerate(words):
        j = i + 1
        while w == _SPDX and j < len(words):
            out.append((i, j))
            if words[j + 1 : j + 2] == ["with"]:
                j += 2
            if words[j + 1 : j + 2] not in (["or"], ["and"]):
                break
            j += 2
    return out


def confirmed_runs(template: Template, words: list[str]) -> list[tuple[int, int, int, bool]]:
    """(start, end, changes, names in place) of the template's runs within its limit, of each place the nearest."""
    near = sorted((c, j) for j, c in enumerate(changes_by_end(list(template.words), words), 1) if c <= template.most)
    named = Counter(w for w, n in zip(template.words, template.names) if n)
    taken, out = bytearray(len(words) + template.most + 1), []
    unnamed = []
    for c, end in near:
        if taken[end - 1]:
            continue
        part = words[max(end - len(template.words) - template.most, 0) : end]
        found = run_before(template, words, end) if not named or all(part.count(w) >= k for w, k in named.items()) else None
        if found is None:
            unnamed.append((c, end))
        elif not any(taken[found[1] : end]):
            # the ends just behind are this run with words added
            taken[found[1] : end + template.most - c] = b"\1" * (end + template.most - c - found[1])
            out.append((found[1], end, found[0], True))
    if named:
        free = Template(template.name, template.words, (False,) * len(template.words), template.most, template.anchors)
        for c, end in unnamed:
            if not taken[end - 1]:
                found = run_before(free, words, end)
                if found is not None and not any(taken[found[1] : end]):
                    taken[found[1] : end + template.most - c] = b"\1" * (end + template.most - c - found[1])
                    out.append((found[1], end, found[0], False))
    return out


def find_matches(words: list[str], held: Prepared) -> list[tuple]:
    """(start, end, license, bytes saved, words changed, template words) of runs that do not overlap.

    Runs with their names in place come before unknown ones, then those on which the dictionary
    saves more. The further identifiers of an SPDX line are matches of their own, each one word long.
    """
    taken, out = bytearray(len(words)), []
    for i, j in spdx_identifiers(words) if _SPDX in words else []:
        start, known = i if j == i + 1 else j, words[j] in held.spdx
        taken[start : j + 1] = b"\1" * (j + 1 - start)
        out.append((start, j + 1, held.spdx.get(words[j], UNKNOWN), 0, int(not known), 2))
    runs = set()
    size = 8 * held.reach  # windows overlap by the longest run
    for at in range(0, max(len(words) - held.reach, 1), size - held.reach):
        window = words[at : at + size]
        seen = set(window)
        for _, t in held.candidates(window):
            if sum(w in seen for w in t.words) < len(t.words) - t.most:
                continue  # a run holds all words of the template but those changed
            for start, end, changes, named in confirmed_runs(t, window):
                saved = held.reduction(window[start:end], t.name)
                runs.add((not named, -saved, changes / len(t.words), -len(t.words), at + start, at + end, t.name, changes))
    for unnamed, saved, _, size_, start, end, name, changes in sorted(runs):
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            out.append((start, end, UNKNOWN if unnamed else name, -saved, changes, -size_))
    return sorted(out)


def scan_text(text: str | None, templates: dict[str, str], most_changes: float) -> list[tuple]:
    """(start, end, license, bytes saved, words changed, template words) of each match."""
    held = prepared(templates, most_changes)
    mentions = held.mentions(text or "")
    if not mentions:
        return []
    out = []
    for spans in candidate_blocks(text, held.reach, mentions):
        words = [_BROKEN.sub("-", text[x:y]).lower() for x, y in spans]
        out += [(spans[i][0], spans[j - 1][1], *rest) for i, j, *rest in find_matches(words, held)]
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, most_changes: float = 0.2) -> DataFrame:
    """Per match: doc_id, start, end, license, saved (bytes), n_changes, n_template, exact."""
    held = dict(templates or TEMPLATES | SPDX_LINES)

    def make():
        return lambda doc_id, text: [
            (doc_id, a, b, name, saved, changes, size, changes == 0)
            for a, b, name, saved, changes, size in scan_text(text, held, most_changes)]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], make,
                    f"doc_id {kind}, start long, end long, license string, saved long, n_changes long, n_template long, exact boolean", many=True)
