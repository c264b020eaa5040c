"""Line deduplication against brute force, with hot lines, repeats, nulls and long texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowbeam.llm import line_dedup

BLANKS = " \t\n\v\f\r"
AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, row string, keep string, n_lines string, h1 int, word int, first int"


def docs_of(spark, rows):
    """documents with extra columns whose names clash with the operator's own"""
    return spark.createDataFrame([(i, t, "a", "b", "c", 1, 2, 3) for i, t in rows], SCHEMA)


def brute(rows, min_chars=10):
    """(doc_id, n_lines, n_dropped, kept text) of each row"""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(AZ)
            if i is not None and len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or i == min(holders.get(x.strip(BLANKS).translate(AZ), {i}))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def found(docs, min_chars=10):
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_chars))
    return [tuple(r) for r in kept.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


EDGES = [
    (3, "A shared line here\nown line of three\nshort\n"), (1, "\ta SHARED line here \r\nshort\nmore of one"),
    (2, None), (4, ""), (5, "\n"), (None, "a shared line here\nnothing else"), (7, "ÉCOLE des lignes\n\x85 a shared line here"),
    (8, "école des lignes\nÉCOLE des lignes"), (9, "\n".join(["twice in one text"] * 3)), (9, "\n".join(["twice in one text"] * 3)),
    (9, "another row of nine\nmore of one\na shared line here"), (10, "another row of nine\ntwice in one text"), (-5, "MORE OF ONE.\nshort"),
    (11, "nul\x00inside the line\n ten chars \n nine chr "), (12, "ten  chars\nNUL\x00INSIDE the line\nten chars\nnine chr"),
]


def test_edges_equal_brute_force(spark):
    got = found(docs_of(spark, EDGES))
    assert ordered(got) == ordered(brute(EDGES))
    by_id = {r[0]: r for r in got}
    assert by_id[2][1:] == (1, 0, "") and by_id[None][2] == 0 and by_id[8][2] == 1


@pytest.mark.parametrize("hot", [1, 5, 1000])
def test_random_lines_equal_brute_force(spark, monkeypatch, hot):
    """The same result whichever hashes are settled beforehand; one line is in a third of all."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    rng = random.Random(hot)
    pool = [f"line number {k} of the pool" for k in range(60)]
    rows = []
    for i in range(200):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"only in {i} at {j}" for j in range(rng.randrange(0, 150))]
        rows.append((i * 7 % 200, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines + ["the very common line"] * (i % 3))))
    assert ordered(found(docs_of(spark, rows))) == ordered(brute(rows))


def test_long_text_and_its_bitmap(spark):
    text = "\n".join(f"line {j} of a long text" if j % 1000 else "the marker line" for j in range(100_000))
    rows = [(1, "the marker line"), (2, text)]
    docs = docs_of(spark, rows)
    assert ordered(found(docs)) == ordered(brute(rows))
    bitmap = line_dedup.keep_bitmaps(docs).filter("doc_id = 2").first()
    # one word for each dropped line, and the kept words before it as a number
    assert (bitmap.n_lines, bitmap.n_dropped, len(bitmap.keep)) == (100_000, 100, 100)
    assert sum(w.skip + 1 for w in bitmap.keep) == 99_000 // 64 + 1


def test_columns_and_empty_table(spark):
    docs = docs_of(spark, EDGES)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.schema.names == docs.schema.names and out.filter("keep = 'b' and row = 'a'").count() == len(EDGES)
    assert found(docs_of(spark, [])) == []


def test_native_and_first_occurrences_stream_without_second_shuffle(spark):
    lines = line_dedup.line_hashes(docs_of(spark, EDGES))
    hot = spark.createDataFrame([], "h1 long, h2 long, first long")
    plan = line_dedup.repeated_lines(lines, hot)._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "rangepartitioning(h1" in window and "Python" not in plan and "Arrow" not in plan
    assert window.index("rangepartitioning") < (window.find("hashpartitioning") if "hashpartitioning" in window else len(window))


def test_hash_of_kept_text(spark):
    row = line_dedup.apply_bitmaps(docs_of(spark, [(1, "é\nx")]), line_dedup.keep_bitmaps(docs_of(spark, [(1, "é\nx")])))
    assert row.select(F.sha2("kept", 256)).first()[0] == hashlib.sha256("é\nx".encode()).hexdigest()
