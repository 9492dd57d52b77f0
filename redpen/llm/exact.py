"""Integer inner products that stay exact whatever the size of the components."""

from __future__ import annotations

import numpy as np


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a matrix of finite doubles, as doubles that hold the integers exactly, or else as Python integers.

    ``scale`` is a power of two, so that the product of a double is exact unless it overflows.
    """
    with np.errstate(over="ignore"):
        product = x * float(scale)
    if np.isfinite(product).all():
        return np.floor(product)
    whole = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = whole
    return out.reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of all rows of ``a`` with all rows of ``b``: 64-bit integers, or Python integers where those may not do."""
    width = max(a.shape[1], 1)
    if a.dtype != object and b.dtype != object:
        reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
        if reach < 2.0**53:
            return (a @ b.T).astype(np.int64)
        if reach < 2.0**62:
            # an integer behind zeros is beyond 2**53 only if the other side is small, so the conversion is exact
            return a.astype(np.int64) @ b.astype(np.int64).T
    return _integers(a) @ _integers(b).T


def _integers(x: np.ndarray) -> np.ndarray:
    if x.dtype == object:
        return x
    out = np.empty(x.size, object)
    out[:] = [int(v) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def longs(scores: np.ndarray) -> np.ndarray:
    """Scores of an answer as 64-bit integers; one that does not fit is an error, never a wrong number."""
    if scores.dtype == object and any(not -(1 << 63) <= int(s) < 1 << 63 for s in scores):
        raise OverflowError("a score of the answer does not fit 64 bits")
    return scores.astype(np.int64)
