"""Word and shingle kernels shared by the corpus operators (numpy, one document at a time).

A word is a maximal run of characters other than space and U+0009-U+000D; on UTF-8 bytes that
is ``bytes.split()``. Lower-casing touches A-Z only. Words and shingles are represented by
64-bit hashes; two different shingles share a hash with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; none for null or empty text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, in order."""
    # digests are big-endian; a remembered hash a word costs more than hashing it again
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mix64(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    z = (values ^ (values >> _S30)) * _MIX1
    z = (z ^ (z >> _S27)) * _MIX2
    return z ^ (z >> _S31)


def ngram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words (order matters), in text order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = hashes[:n]
    for j in range(1, size):
        acc = (acc ^ (acc >> _S30)) * _MULT + hashes[j : j + n]
    return mix64(acc)


def shingle_sequence(hashes: np.ndarray, size: int) -> np.ndarray:
    """Shingle hashes in text order; fewer words than ``size`` give the whole sequence as one."""
    if 0 < len(hashes) < size:
        return ngram_hashes(hashes, len(hashes))
    return ngram_hashes(hashes, size)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_sequence(hash_words(lower_words(text)), size))
