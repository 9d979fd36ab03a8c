"""Anchors that content defines: of each window of `span` consecutive k-gram hashes the least (all of equal ones).

Equal stretches of at least span + k - 1 symbols have anchors at equal places, so that a stretch of just this length
can be repeated only if its own least k-gram is a repeated anchor. About 2 / (span + 1) of all places are anchors."""

from __future__ import annotations

import numpy as np


def slide(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + size], for each i where that is whole."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def slide_first(x: np.ndarray, size: int) -> np.ndarray:
    """Where the first of the least values of x[i : i + size] is, for each i where that is whole."""
    at, have = np.arange(len(x)), 1
    while have < size:
        step = min(have, size - have)
        left = x[:-step] <= x[step:]
        at = np.where(left, at[:-step], at[step:])
        x = np.where(left, x[:-step], x[step:])
        have += step
    return at


def anchors(hashes: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """Places of anchors among the k-gram hashes of documents one after the other; doc is the document of each.
    Documents with fewer k-grams than span have none."""
    n = len(hashes)
    if n < span:
        return np.zeros(0, np.int64)
    low = slide(hashes, span, np.minimum)
    low = np.where(doc[span - 1 :] == doc[: n - span + 1], low, np.uint64(0))
    edge = np.zeros(span - 1, np.uint64)
    high = slide(np.concatenate([edge, low, edge]), span, np.maximum)
    return np.flatnonzero(high == hashes)


def marked_runs(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0
