"""Counts over one text that quality rules and classifiers are built on."""

from __future__ import annotations

import numpy as np

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".!?"
_PUNCT = b".,;:!?'\"()[]{}-_/\\"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_digits long, n_punct long, n_bangs long, n_distinct long, n_top long"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def window_keys(ids: np.ndarray, distinct: int, size: int) -> np.ndarray:
    """An integer per run of ``size`` ids, equal exactly when the runs are equal."""
    n = len(ids) - size + 1
    keys, base = ids[:n].astype(np.uint64), max(distinct, 1)
    span = base  # keys are below this
    for j in range(1, size):
        if span * base >= 1 << 63:
            keys = np.unique(keys, return_inverse=True)[1].astype(np.uint64)
            span = n
        keys = keys * np.uint64(base) + ids[j : j + n].astype(np.uint64)
        span *= base
    return keys


def repeated_window_words(ids: np.ndarray, distinct: int, size: int = 5) -> int:
    """Words that lie in a run of ``size`` words found twice or more."""
    if len(ids) <= size:
        return 0
    keys = window_keys(ids, distinct, size)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    steps = np.zeros(len(ids) + 1, np.int32)
    at = order[twice]
    steps[at] += 1
    steps[at + size] -= 1
    return int((np.cumsum(steps) > 0).sum())


def text_stats(text: str | None) -> tuple:
    """The counts of ``SCHEMA``; all zero for null and empty texts. Case is kept."""
    if not text:
        return (0,) * len(NAMES)
    data = text.encode("utf-8", "surrogatepass")
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in data.split()], np.int64)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(ids),
        len(text) - _count(data, _SPACE),
        _count(data, _SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_window_words(ids, len(seen)),
        len(lines),
        _count(data, _UPPER),
        _count(data, _DIGITS),
        _count(data, _PUNCT),
        data.count(b"!"),
        len(seen),
        int(np.bincount(ids).max()) if len(ids) else 0,
    )
