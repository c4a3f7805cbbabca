"""Hashed word n-grams and skip-grams of Arrow batches, for the two classifiers."""

from __future__ import annotations

import numpy as np

from .hashing import U, Words, mix

_A, _B = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)


def grams(words: Words, kinds: tuple[str, ...], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind (1: word, 2: pair, skip: pair with one word between) its buckets and their texts."""
    h, n = words.hash, words.count()
    doc = np.repeat(np.arange(len(n)), n)
    out = []
    with np.errstate(over="ignore"):
        for kind in kinds:
            far = {"1": 0, "2": 1, "skip": 2}[kind]
            if not far:
                code, at = mix(h, 11), doc
            else:
                same = doc[far:] == doc[:-far]
                code, at = mix(h[:-far][same] * _A + h[far:][same] * _B, 11 + far), doc[:-far][same]
            out.append(((code % U(buckets)).astype(np.int64), at))
    return out
