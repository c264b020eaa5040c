"""Whitening against exact moments and a direct decomposition, with bad and dependent vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowbeam.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n string, entries int, whitened string"


def table(spark, rows, parts=3):
    """vectors with extra columns whose names clash with the operator's own"""
    return spark.createDataFrame([(i, v, "a", "b", 1, "c") for i, v in rows], SCHEMA).repartition(parts)


def whitened(spark, rows, **options):
    df = table(spark, rows)
    model = whitening.fit_whitening(df, **options)
    return model, whitening.whiten(df, model).collect()


def integers(vectors):
    return [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]


def exact_numerators(x):
    n, sums = len(x), [sum(col) for col in zip(*x)]
    return [[n * e - s for e, s in zip(row, sums)] for row in x]


def test_equals_direct_decomposition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40)) * np.logspace(0, 3, 40)).tolist()
    model, rows = whitened(spark, list(enumerate(vectors)))
    y = exact_numerators(integers(vectors))
    n = len(y)
    left, values, right = np.linalg.svd(np.array(y, float) / n, full_matrices=False)
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    got = np.zeros((n, 32))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.abs(got) - np.abs(left[:, :32]) * np.sqrt(n)).max() < 1e-9
    signs = np.sign((got * left[:, :32]).sum(axis=0))
    assert np.abs(got - left[:, :32] * signs * np.sqrt(n)).max() < 1e-9  # one sign for all rows
    explained = {r.component: r.explained for r in rows}
    assert np.allclose([explained[c] for c in range(1, 33)], (values**2 / (values**2).sum())[:32], rtol=1e-9)
    by_id = {r.vec_id: r.deviation for r in rows}
    assert by_id == {i: sum(e * e for e in row) for i, row in enumerate(y)}
    assert model.identity_error < 1e-11 and {r.identity_error for r in rows} == {model.identity_error}


def hadamard(k):
    h = np.ones((1, 1))
    while len(h) < k:
        h = np.block([[h, h], [h, -h]])
    return h


def test_components_that_a_gram_matrix_loses(spark):
    """Deviations of 1 beside 2**34: eigenvalues apart by 2**68."""
    h, a = hadamard(64)[:, 1:5], 2.0**34
    x = np.column_stack([a * h[:, 0] + h[:, 1], a * h[:, 0] - h[:, 1], 1000 * h[:, 2], 30 * h[:, 3]])
    model, rows = whitened(spark, list(enumerate((x / 64).tolist())))
    assert np.allclose(model.eigenvalues, [2 * a * a, 1e6, 900, 2], rtol=1e-4)
    assert model.identity_error < 1e-4
    last = sorted((r.vec_id, r.whitened) for r in rows if r.component == 4)
    assert np.allclose(np.abs([w for _, w in last]), 1, atol=1e-4) and abs(sum(w * h[i, 1] for i, w in last)) > 63.9
    gram = np.linalg.eigvalsh((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / 64)
    assert not np.allclose(sorted(gram)[0], 2, rtol=0.5)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 3)) * 10
    x = np.floor(64 * base) / 64
    vectors = np.column_stack([x, x[:, 0], x[:, 0] + x[:, 1], np.full(300, 7.0), np.zeros(300)])
    model, rows = whitened(spark, list(enumerate(vectors.tolist())))
    assert model.rank == 3 and model.identity_error < 1e-10 and len(rows) == 900
    assert np.allclose(sum(model.explained), 1)
    few, rows = whitened(spark, list(enumerate(rng.normal(size=(4, 10)).tolist())))  # fewer rows than dimensions
    assert few.rank == 3 and few.identity_error < 1e-8 and len(rows) == 12


def test_bad_vectors_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [3.0, -2.0]), (2, [3.0, -2.0]), (None, [0.5, 0.25])]
    bad = [(5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, -inf]), (10, [1.0]), (11, []), (12, [1e300, 1.0])]
    model, rows = whitened(spark, good + bad)
    assert model.n == 4 and sorted((r.vec_id or 0) for r in rows) == [0, 0, 1, 1, 2, 2, 2, 2]
    y = exact_numerators(integers([v for _, v in good]))
    assert model.sums == [sum(c) for c in zip(*integers([v for _, v in good]))]
    assert {r.deviation for r in rows if r.vec_id == 1} == {sum(e * e for e in y[0])}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [3.0, 4.0]) for i in range(5)]])
def test_nothing_to_whiten(spark, rows):
    assert whitened(spark, rows)[1] == []


def test_integers_beyond_a_long():
    x = np.array([[2**52, 5], [-(2**52), 7], [0, 9]], np.int64)
    n, sums = 10**9, [int(v) for v in x.sum(axis=0)]
    y = whitening.numerators(x, n, sums)
    assert y.tolist() == [[n * int(e) - s for e, s in zip(row, sums)] for row in x]
    assert whitening.deviations(y)[0] is None
    small = whitening.numerators(x, 3, sums)
    assert small.tolist() == [[3 * int(e) - s for e, s in zip(row, sums)] for row in x]
    assert whitening.deviations(np.array([[2**31, 2**31], [3, 4]], np.int64)) == [None, 25]


def test_float_vectors_and_key_type(spark):
    df = table(spark, [(i, [i * 0.37, i * i * 0.11]) for i in range(9)]).select(
        F.concat(F.lit("v"), "vec_id").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    out = whitening.whiten(df, whitening.fit_whitening(df))
    assert out.schema["vec_id"].dataType.simpleString() == "string" and out.count() == 18
