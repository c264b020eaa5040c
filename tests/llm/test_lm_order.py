"""Sorting and hashing of the language model's counts: the plain forms' results, in fewer passes."""

import numpy as np
import pytest
import xxhash

from flowbeam.llm import kn_lm
from flowbeam.llm.text import hash_words


@pytest.mark.parametrize("most", [[1, 1, 1], [0, 9, 0], [5, 1 << 20, 300], [1 << 40, 1 << 40, 7], [(1 << 64) - 1, 2, (1 << 64) - 1]])
def test_order_is_the_order_of_words(most):
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, m, 500, np.uint64, endpoint=True) % np.uint64(max(1, m // 3)) for m in most]
    columns = [np.append(c, np.uint64(m)) for c, m in zip(columns, most)]
    order = kn_lm._order(columns)
    assert [tuple(c[i] for c in columns) for i in order] == sorted(zip(*columns))
    found, counts = kn_lm._grouped(columns, np.ones(501, np.int64))
    assert list(zip(*found)) == sorted(set(zip(*columns))) and counts.sum() == 501


def test_order_of_narrow_columns_is_one_sort(monkeypatch):
    monkeypatch.setattr(np, "lexsort", lambda *_: pytest.fail("sorted column by column"))
    columns = [np.array([3, 1, 2], "<u8"), np.array([0, 5, 5], "<u8"), np.array([1, 1, 0], "<u8")]
    assert kn_lm._grouped(columns, np.array([1, 2, 3]))[1].tolist() == [2, 3, 1]


def test_totals_and_distinct_keys():
    keys = np.array([7, 3, 7, 7, 3, 9], np.uint64)
    names, at, back = kn_lm._distinct(keys)
    assert names.tolist() == [3, 7, 9] and (keys[at] == names).all() and (names[back] == keys).all()
    assert [len(x) for x in kn_lm._distinct(keys[:0])] == [0, 0, 0]
    names, sums = kn_lm._totals([keys], np.array([1, 2, 5, 1, 3, 1]))
    of = dict(zip(names.tolist(), sums.tolist()))
    assert [of[int(kn_lm._key([np.array([k], np.uint64)])[0])] for k in (3, 7, 9)] == [[5, 0, 1, 1], [7, 2, 0, 1], [1, 1, 0, 0]]


def test_hashes_of_words():
    words = [b"a", b"", b"straw", "größe".encode(), b"a"]
    assert hash_words(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words] and len(hash_words([])) == 0
