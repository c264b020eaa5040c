"""Secret scan: key assignments, access keys, long hex runs, and high-entropy strings.

Three pattern kinds (``assign``, ``access``, ``hex``) are found leftmost and non-overlapping
per kind; matches below the minimum length are dropped. On top, a window slides over each
candidate string (a run of base64 characters) once per character class; the window's Shannon
entropy follows from counts that change by one character out and one in. Windows over the
class threshold are merged into a span of kind ``entropy``. Windows lie outside the pattern spans
and outside what the allow-list suppresses: UUIDs, the parts of a candidate (runs of letters and
digits) that hold a placeholder or a sequence, and pieces that are all plain words or numbers.
The rest of a candidate is looked at as if these were not there, so a key beside them is found.

Nulls and empty texts give no spans; every row of the input gives one row, in whatever number
a ``doc_id`` (null included) occurs. Spans that touch are one span. Work grows with the text's
length, but for sorting what is found.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from flowbeam.llm.frames import map_rows

_ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
# The minimum lengths are part of these two patterns: a run that is too short holds no other match.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
PATTERN_KINDS = ("assign", "access", "hex")
#: Strings that are looked at by entropy.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class EntropyClass:
    """A character class, the window slid over its runs, and the bits per character that count."""

    name: str
    run: re.Pattern
    window: int
    bits: float


CLASSES = (
    EntropyClass("hex", re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0),
    EntropyClass("upper", re.compile(r"[A-Z0-9]{20,}"), 20, 3.4),
    EntropyClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0),
)

_LETTERS = re.compile(r"[A-Za-z]+")
_LETTERS_ONLY = re.compile(r"[A-Za-z/_-]+")
#: Per letter, the letters that commonly follow it in written words.
_FOLLOWERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (
    "bcdfgiklmnprstuvwy abeijlorsuy acehiklorstuy adegilorsuvwy acdefgilmnopqrstuvwxy aefilortuy aeghilnorsuy aeiortuy "
    "abcdefgklmnoprstvz aeou aeilnosy adefikmlopstuvy abeimnopsuy acdefgiknostuvy abcdfgiklmnoprstuvwxy aehiloprstuy u "
    "abcdefgiklmnoprstuvy acehiklmnopqstuwy acehilmorstuwy abcdefgilmnprst aeioy aehinors aceipt aeilmnopst aeioyz").split()))
_COMMON_PAIRS = frozenset(a + b for a, after in _FOLLOWERS.items() for b in after)


class PlainWords:
    """Paths, compounds and camel case of plain words: letters and separators only, in word-like parts.

    A part changes from lower to upper case at most once in four letters, and of all pairs of
    neighbouring letters at least 88 % are common ones (about 46 % of all pairs are), of those in a
    part of 16 letters and more at least 75 %. Each character is looked at a fixed number of times.
    """

    def fullmatch(self, value: str) -> bool:
        if not _LETTERS_ONLY.fullmatch(value):
            return False
        pairs = common = 0
        for part in _LETTERS.findall(value):
            if 4 * sum(a.islower() and b.isupper() for a, b in zip(part, part[1:])) > len(part):
                return False
            low = part.lower()
            here = sum(low[i : i + 2] in _COMMON_PAIRS for i in range(len(low) - 1))
            if len(low) >= 16 and 100 * here < 75 * (len(low) - 1):
                return False
            pairs += len(low) - 1
            common += here
        return 100 * common >= 88 * max(pairs, 1)


#: Suppressed where they stand in a candidate, whatever is beside them.
_UUID = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
#: Placeholders and sequences: the parts that they are in are suppressed.
_PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your[-_]?key|xxxx|abcdefgh|0123456789|qwertyui")
_PART = re.compile(r"[A-Za-z0-9]+")
#: Whole pieces that look random by counts but are not secrets.
ALLOW_LIST = (
    PlainWords(),
    re.compile(r"[0-9+/_=-]+"),  # numbers and rules
)


def high_entropy_windows(text: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of windows of ``window`` characters with at least ``bits`` bits each.

    Entropy is log2(w) - sum(c*log2(c))/w; the sum is updated for the two counts that change.
    """
    if len(text) < window:
        return []
    term = [0.0, 0.0, *(c * math.log2(c) for c in range(2, window + 2))]  # the next character comes before the first goes
    counts: dict[str, int] = {}
    total = 0.0
    limit = (math.log2(window) - bits) * window + 1e-9  # the largest sum that still counts
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        if i >= window:
            gone = text[i - window]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
        if i >= window - 1 and total <= limit:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def allowed(value: str, allow_list=ALLOW_LIST) -> bool:
    """Whether a string is suppressed by the allow-list (whole-string match)."""
    return any(p.fullmatch(value) for p in allow_list)


def suppressed_parts(value: str) -> list[tuple[int, int]]:
    """Spans of UUIDs and of parts with a placeholder or a sequence, merged."""
    found = [m.span() for m in _UUID.finditer(value)]
    words = [m.span() for m in _PLACEHOLDER.finditer(value)]
    if words:
        parts = [m.span() for m in _PART.finditer(value)]
        starts = [a for a, _ in parts]
        # every placeholder begins and ends with a letter or digit, so both ends are in a part
        found += [(parts[bisect_right(starts, a) - 1][0], parts[bisect_right(starts, b - 1) - 1][1]) for a, b in words]
    return merged(found)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(spans: Iterable[tuple[int, int]], cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of ``spans`` outside ``cuts``; both in order and without overlap, each read once."""
    k = 0
    for a, b in spans:
        while k < len(cuts) and cuts[k][1] <= a:
            k += 1
        while k < len(cuts) and cuts[k][0] < b:
            if a < cuts[k][0]:
                yield a, cuts[k][0]
            a = cuts[k][1]
            if a >= b:
                break
            k += 1
        if a < b:
            yield a, b


def pattern_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the three pattern kinds."""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 6],
        "access": [m.span() for m in _ACCESS.finditer(text)],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def entropy_spans(text: str, taken: list[tuple[int, int]], classes=CLASSES, allow_list=ALLOW_LIST):
    """High-entropy spans outside ``taken``, over all character classes, merged."""
    found = []
    for a, b in outside((m.span() for m in _CANDIDATE.finditer(text)), merged(taken)):
        cuts = [(a + x, a + y) for x, y in suppressed_parts(text[a:b])]
        for start, end in outside([(a, b)], cuts):
            value = text[start:end]
            if allowed(value, allow_list):
                continue
            for cls in classes:
                for run in cls.run.finditer(value):
                    for x, y in high_entropy_windows(run[0], cls.window, cls.bits):
                        if not allowed(run[0][x:y], allow_list):
                            found.append((start + run.start() + x, start + run.start() + y))
    return merged(found)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_text(text: str | None):
    """(spans by start, number of spans per pattern kind, digest of the pattern spans)."""
    text = text or ""
    base = pattern_spans(text)
    order = {k: i for i, k in enumerate((*PATTERN_KINDS, "entropy"))}
    listed = sorted(((k, a, b) for k, s in base.items() for a, b in s), key=lambda x: (x[1], order[x[0]]))
    extra = [("entropy", a, b) for a, b in entropy_spans(text, [(a, b) for _, a, b in listed])]
    spans = sorted(listed + extra, key=lambda x: (x[1], order[x[0]]))
    digest = hashlib.sha256(joined(listed).encode()).hexdigest()
    return spans, {k: len(s) for k, s in base.items()}, digest


def scan_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts per pattern kind, digest of the pattern spans, all spans."""

    def make():
        def row(doc_id, text):
            spans, counts, digest = scan_text(text)
            return (doc_id, *(counts[k] for k in PATTERN_KINDS), digest, joined(spans), len(spans) - sum(counts.values()))

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs, [id_col, text_col], make,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long",
    )
