"""Periodic runs against brute force over small alphabets, and the query's digests."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from flowbeam.llm import periodic, queries

SCHEMA = "doc_id long, text string, row string, runs string, collapsed int, n_words int"


def docs_of(spark, rows):
    """documents with extra columns whose names clash with the operator's own"""
    return spark.createDataFrame([(i, t, "a", "b", 1, 2) for i, t in rows], SCHEMA)


def brute(words, least=12):
    """Maximal stretches for every period, the smallest period of each stretch."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in best.items() if j - i >= max(least, 2 * q))


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    texts = ["", None, "a", "a a", " ".join("a" * 40), " ".join("abaababaabaababaababa")]
    for _ in range(400):
        letters = "abcd"[: rng.randrange(1, 5)]
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        if rng.random() < 0.5:
            text += text[-rng.randrange(1, 9) :] * rng.randrange(1, 8) + "".join(rng.choice(letters) for _ in range(5))
        texts.append(" ".join(text * rng.randrange(1, 3)))
    for text, (n, runs, kept) in zip(texts, periodic.runs_of_texts(texts, least)):
        words = (text or "").split()
        assert n == len(words) and runs == brute(words, least), text
        assert kept == collapsed(words, runs)


def test_fibonacci_word_and_nested_runs():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    ((_, runs, _),) = periodic.runs_of_texts([" ".join(b)], 2)
    assert runs == brute(list(b), 2)
    nested = ("ab" * 8 + "c") * 6
    ((_, runs, _),) = periodic.runs_of_texts([" ".join(nested)])
    assert runs == brute(list(nested)) and (0, 102, 17) in runs and (0, 16, 2) in runs


def test_long_texts():
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in rng.integers(0, 5000, 120_000)]
    words[50_000:80_000] = [words[50_000 + k % 7001] for k in range(30_000)]
    words[100_000:110_000] = ["again"] * 10_000
    ((n, runs, kept),) = periodic.runs_of_texts([" ".join(words)])
    assert n == 120_000 and len(runs) == 2
    (s, length, q), same = runs
    assert (q, same) == (7001, (100_000, 10_000, 1)) and s <= 50_000 and s + length >= 80_000
    assert kept == collapsed(words, runs)
    assert next(periodic.runs_of_texts(["a " * 300_000]))[1] == [(0, 300_000, 1)]


def test_documents_do_not_meet():
    text = " ".join("abcdefgh")
    assert [r for _, r, _ in periodic.runs_of_texts([text] * 50)] == [[]] * 50


EDGES = [
    (1, None), (2, ""), (3, " \t\n\r\v\f "), (4, "x " * 13), (4, "x " * 13), (None, "a b " * 9), (6, "École\x85 é e " * 7),
    (7, "one two three"), (8, "p q " * 6 + "p"), (9, "p q " * 5 + "p"),
]


def test_edges(spark):
    docs = docs_of(spark, EDGES)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect()), key=repr)
    wanted = []
    for i, t in EDGES:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        wanted.append((i, len(words), brute(words), collapsed(words, brute(words))))
    assert got == sorted(wanted, key=repr)
    out = periodic.collapse_runs(docs)
    assert out.schema.names == docs.schema.names and out.filter("row = 'a' and text = 'x'").count() == 2
    assert periodic.find_runs(docs_of(spark, [])).count() == 0


def expected(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *four, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(collapsed(words, runs)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " \n".join(rng.choice("abcdefgé") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    rows += [(i, t) for i, t in ((1001, None), (1014, ""), (1002, "  "))] + [(i, None) for i in range(2000, 2030)] + [(i, " ") for i in range(2030, 2060)]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected(i, t) for i, t in rows)
