"""Personal data: patterns, and a skip-chain CRF that labels what repeats or resembles them.

Pattern spans (e-mail, IP address, card and phone number) are found leftmost and
non-overlapping per kind and always stay. The CRF labels the tokens that hold a digit or an
``@``, a number written over several tokens as one; every other token is fixed to "none", which
cuts the chain into short runs. Factors:

* a unary factor per token from its shape, fitted by multinomial logistic regression,
* a chain factor between neighbouring such tokens,
* a skip factor between tokens with the same key (the last seven digits, or the lower-cased
  token), each linked to the key's previous place, so a key found n times costs n - 1 links.

Labels for the fit are the pattern spans of all documents; shapes with their labels, and label
pairs, are counted over whole texts, and chain and skip factors are log odds of these pairs
(piecewise training). Tokens inside pattern
spans are fixed to their kind. Loopy belief propagation (sum-product) passes messages over both
kinds of links; a free token becomes a span when its belief in a kind is at least ``least``,
so a number that a pattern recognised in one place is found where it is written differently.

Null and empty texts have no spans; every input row gives one row, null and repeated ids
included. Work per text grows with its length and its number of candidate tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbeam.llm.frames import map_rows
from flowbeam.session import ship_package

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_SPACE = frozenset(" \t\n\x0b\f\r")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each @: the local part to its left, the domain to its right."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def pattern_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four kinds."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = email_spans(text)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and the separators between them
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= ch <= "9" for ch in m[0]) <= 15:
            out["phone"].append(m.span())
    return out


def candidate_tokens(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or an @."""
    out, end, n = [], 0, len(text)
    m = _SIGN.search(text)
    while m:
        a = b = m.start()
        while a > end and text[a - 1] not in _SPACE:
            a -= 1
        while b < n and text[b] not in _SPACE:
            b += 1
        out.append((a, b))
        end = b
        m = _SIGN.search(text, b)
    return out


# Digit groups joined over single separators, a bracket also with a space.
_GROUPS = re.compile(r"[0-9]+(?:(?:[\x20.-]|\)[\x20.-]?|[\x20.-]?\()[0-9]+)+")
_DIGITS = re.compile(r"[0-9]+")
LEAST_DIGITS, MOST_DIGITS = 7, 19


def digits_of(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def repeated_groups(text: str, a: int, b: int, known: set[str]) -> list[tuple[int, int]]:
    """Spans of whole digit groups in a run, over white space, whose digits are known; the longest first from the left."""
    groups = [m.span() for m in _DIGITS.finditer(text, a, b)]
    out, i = [], 0
    while i < len(groups):
        digits, best = "", i
        for j in range(i, len(groups)):
            if len(digits) + groups[j][1] - groups[j][0] > MOST_DIGITS:
                break
            digits += text[groups[j][0] : groups[j][1]]
            if j > i and (digits in known or digits.lstrip("0") in known):
                best = j
        if best > i:
            start = groups[i][0]
            start -= start > 0 and text[start - 1] == "("
            if " " in text[start : groups[best][1]]:
                out.append((start, groups[best][1]))
        i = best + 1
    return out


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an @; numbers written over several tokens are one candidate.

    These are the recognised card and phone numbers, and runs of digit groups whose digits equal
    the end (seven digits and more) of a recognised number or of a token elsewhere.
    """
    tokens = candidate_tokens(text)
    wide, end = [], 0
    for a, b in sorted(base["card"] + base["phone"]):
        if a >= end:
            wide.append((a, b))
            end = b
    known = set()
    for a, b in wide + [t for t in tokens if t[1] - t[0] >= LEAST_DIGITS]:
        if b - a <= 4 * MOST_DIGITS and LEAST_DIGITS <= len(d := digits_of(text[a:b])) <= MOST_DIGITS:
            known.update(d[k:] for k in range(len(d) - LEAST_DIGITS + 1))
    if known:
        taken = iter([*wide, (len(text) + 1, len(text) + 1)])
        x, y = next(taken)
        for m in _GROUPS.finditer(text):
            if " " not in m[0]:
                continue
            parts, at = [], m.start()
            while x < m.end():  # the run without the recognised numbers in it
                parts.append((at, x))
                at = max(at, y)
                if y > m.end():
                    break
                x, y = next(taken)
            parts.append((at, m.end()))
            for a, b in parts:
                if a < b:
                    wide += repeated_groups(text, a, b, known)
    wide = sorted(s for s in wide if " " in text[s[0] : s[1]])
    if not wide:
        return tokens
    out, i = [], 0
    for a, b in tokens:
        while i < len(wide) and wide[i][1] <= a:
            i += 1
        if i == len(wide) or b <= wide[i][0]:
            out.append((a, b))
    return sorted(out + wide)


FEATURES = 20


def token_features(token: str) -> list[float]:
    """Shape of a token: lengths, digits, separators; shares in sixteenths, so that distinct shapes are few."""
    core = token.strip(".,;:!?\"'()[]")
    digits = sum("0" <= ch <= "9" for ch in core)
    if digits >= LEAST_DIGITS and len(core) <= 4 * MOST_DIGITS and _GROUPS.fullmatch(core):
        groups = _DIGITS.findall(core)
        if len(groups) > 2 and not (len(groups) == 4 and core.count(".") == 3):  # separators of a number are alike
            core = "-".join(groups)
    letters = sum(ch.isalpha() for ch in core)
    parts = core.split(".")
    return [
        1.0, round(16 * digits / max(len(core), 1)) / 16, round(16 * letters / max(len(core), 1)) / 16, float(digits == len(core)),
        float(digits <= 2), float(3 <= digits <= 4), float(5 <= digits <= 8), float(9 <= digits <= 12),
        float(13 <= digits <= 19), float(digits > 19), float("@" in core[1:-1]),
        float("@" in core and "." in core.rpartition("@")[2]), float(core.startswith("+")),
        float("-" in core), float("." in core), float(len(parts) == 4 and all(p.isdigit() for p in parts)),
        float(token.startswith("(")), float("/" in core or "=" in core or '"' in token), float(letters > 4 and "@" not in core),
        float(len(core) > 24),
    ]


def token_key(token: str) -> str:
    """What distant tokens are compared by."""
    digits = "".join(ch for ch in token if "0" <= ch <= "9")
    if "@" in token:
        return token.strip(".,;:!?\"'()[]<>").lower()
    return digits[-7:] if len(digits) >= 7 else token.strip(".,;:!?\"'()[]")


@dataclass
class SkipChainCRF:
    unary: np.ndarray  # FEATURES x labels
    chain: np.ndarray  # labels x labels, log factors
    skip: np.ndarray

    def beliefs(self, features: np.ndarray, fixed: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = 12) -> np.ndarray:
        """Marginals (tokens x labels) by loopy sum-product; ``fixed`` is a label or -1."""
        local = features @ self.unary
        held = fixed >= 0
        local[held] = -30.0
        local[held, fixed[held]] = 0.0
        a = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        b = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        factors = np.concatenate([
            np.repeat(self.chain[None], len(chain), 0), np.repeat(self.chain.T[None], len(chain), 0),
            np.repeat(self.skip[None], len(skip), 0), np.repeat(self.skip.T[None], len(skip), 0)])
        n, m, s = len(a), len(chain), len(skip)
        back = np.concatenate([np.arange(m) + m, np.arange(m), np.arange(s) + 2 * m + s, np.arange(s) + 2 * m]).astype(int)
        messages = np.zeros((n, local.shape[1]))
        for _ in range(rounds if n else 0):
            total = local.copy()
            np.add.at(total, b, messages)
            out = (total[a] - messages[back])[:, :, None] + factors
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - messages).max() < 1e-4:
                messages = new
                break
            messages = 0.5 * (messages + new)
        total = local
        np.add.at(total, b, messages)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True)


def _graph(text: str, tokens: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Chain links between neighbours with only white space between, skip links by key."""
    chain, skip, last = [], [], {}
    for i, (a, b) in enumerate(tokens):
        if i and a - tokens[i - 1][1] <= 2 and not text[tokens[i - 1][1] : a].strip():
            chain.append((i - 1, i))
        key = token_key(text[a:b])
        if len(key) >= 5:
            if key in last and last[key] != i - 1:
                skip.append((last[key], i))
            elif key in last:
                skip.append((i - 1, i))
            last[key] = i
    shape = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return shape(chain), shape(skip)


def _fixed(tokens: list[tuple[int, int]], base: dict[str, list[tuple[int, int]]]) -> np.ndarray:
    """Label of the tokens that overlap a pattern span, else -1."""
    fixed = np.full(len(tokens), -1, np.int64)
    for label, kind in enumerate(KINDS, 1):
        i = 0
        for a, b in base[kind]:
            while i < len(tokens) and tokens[i][1] <= a:
                i += 1
            j = i
            while j < len(tokens) and tokens[j][0] < b:
                if fixed[j] < 0:
                    fixed[j] = label
                j += 1
    return fixed


def label_text(text: str | None, crf: SkipChainCRF, least: float = 0.9):
    """(pattern spans by kind, added spans): spans are (kind, start, end)."""
    text = text or ""
    base = pattern_spans(text)
    tokens = candidates(text, base)
    fixed = _fixed(tokens, base)
    free = fixed < 0
    if not free.any():
        return base, []
    features = np.array([token_features(text[a:b]) for a, b in tokens])
    belief = crf.beliefs(features, fixed, *_graph(text, tokens))
    best = belief.argmax(axis=1)
    sure = free & (best > 0) & (belief.max(axis=1) >= least)
    added: list[tuple[str, int, int]] = []
    for i in np.flatnonzero(sure).tolist():
        a, b = tokens[i]
        kind = LABELS[best[i]]
        while b > a + 1 and text[b - 1] in ".,;:!?\"')]":
            b -= 1
        while a < b - 1 and text[a] in "\"'[":
            a += 1
        if added and added[-1][0] == kind and kind != "email" and i and sure[i - 1] and a - added[-1][2] <= 2:
            added[-1] = (kind, added[-1][1], b)
        else:
            added.append((kind, a, b))
    return base, added


def count_text(text: str, counts: Counter) -> None:
    """Add a whole text's statistics: (shape, label) of candidates, label pairs of chain and skip links."""
    base = pattern_spans(text)
    tokens = candidates(text, base)
    if not tokens:
        return
    label = np.maximum(_fixed(tokens, base), 0)
    counts.update(("unary", np.array(token_features(text[a:b])).tobytes(), x) for (a, b), x in zip(tokens, label.tolist()))
    for name, links in zip(("chain", "skip"), _graph(text, tokens)):
        counts.update((name, b"", p) for p in (label[links[:, 0]] * len(LABELS) + label[links[:, 1]]).tolist())


def fit_counts(counts: dict[tuple[str, bytes, int], int], steps: int = 300, penalty: float = 1e-3) -> SkipChainCRF:
    """Fit on the totals of ``count_text``. A kind that occurs weighs a hundredth of the candidates at least."""
    k = len(LABELS)
    pairs = {"chain": np.ones((k, k)), "skip": np.ones((k, k))}
    shapes: dict[bytes, np.ndarray] = {}
    for (name, shape, label), n in sorted(counts.items()):
        if name == "unary":
            shapes.setdefault(shape, np.zeros(k))[label] += n
        else:
            i, j = divmod(label, k)
            pairs[name][i, j] += n
            pairs[name][j, i] += n
    w = np.zeros((FEATURES, k))
    if shapes:
        xs, ys = np.array([np.frombuffer(x) for x in shapes]), np.array(list(shapes.values()))
        share = ys.sum(axis=0) / ys.sum()
        ys = ys / ys.sum() * np.maximum(0.01 / np.where(share > 0, share, 1), 1)
        ys /= ys.sum()
        weight = ys.sum(axis=1, keepdims=True)
        rate = 2.0 / (1e-9 + np.linalg.eigvalsh(xs.T @ (xs * weight))[-1] + penalty)
        for _ in range(steps):
            z = xs @ w
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            w -= rate * (xs.T @ (p * weight - ys) + penalty * w)
    else:
        w[0, 0] = 5.0

    def odds(c: np.ndarray) -> np.ndarray:
        return np.log(c * c.sum() / np.outer(c.sum(axis=1), c.sum(axis=0))).clip(-4, 4)

    # equal labels of linked tokens are never made less likely than by chance
    skip = odds(pairs["skip"])
    skip[np.diag_indices(k)] = np.maximum(np.diag(skip), 2.0)
    return SkipChainCRF(w, odds(pairs["chain"]), skip)


def fit_crf(texts: list[str], steps: int = 300, penalty: float = 1e-3) -> SkipChainCRF:
    """Fit on texts whose pattern spans serve as labels; all other candidate tokens are "none"."""
    counts: Counter = Counter()
    for text in texts:
        count_text(text, counts)
    return fit_counts(counts, steps, penalty)


#: Distinct statistics that a task holds before it sends them on.
HELD_COUNTS = 100_000


def train_crf(docs: DataFrame) -> SkipChainCRF:
    """Fit on the statistics of all whole texts, counted in tasks and added up in Spark."""
    ship_package(docs.sparkSession)
    kind = T._parse_datatype_string("name string, shape binary, label int, n long")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def held():
            rows = [(*key, n) for key, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for text in batch.column(0):
                count_text(text.as_py() or "", counts)
                if len(counts) >= HELD_COUNTS:
                    yield held()
        if counts:
            yield held()

    # shapes are discrete, so what reaches the driver does not grow with the documents
    totals = docs.filter(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(run, kind).groupBy("name", "shape", "label").agg(F.sum("n").alias("n"))
    return fit_counts({(r["name"], bytes(r["shape"]), r["label"]): r["n"] for r in totals.toLocalIterator()})


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(docs: DataFrame, crf: SkipChainCRF, least: float = 0.9) -> DataFrame:
    """Per row: doc_id, counts per kind, digest of the pattern spans, all spans by kind and start."""

    def make():
        def row(doc_id, text):
            base, added = label_text(text, crf, least)
            listed = [(k, a, b) for k in KINDS for a, b in base[k]]
            order = {k: i for i, k in enumerate(KINDS)}
            every = sorted(listed + added, key=lambda s: (order[s[0]], s[1]))
            digest = hashlib.sha256(joined(listed).encode()).hexdigest()
            return (doc_id, *(len(base[k]) for k in KINDS), digest, joined(every), len(added))

        return row

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, ["doc_id", "text"], make,
                    f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
