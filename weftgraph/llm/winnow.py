"""Window minima over character q-grams, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P1, _P2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser of a public multiply-xorshift generator)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Identifies two hashes, in their order, and the distance between them."""
    with np.errstate(over="ignore"):
        return mix(mix(a + _U(_P1)) + b * _U(_P2 | 1) + step.astype(_U))


#: Powers of a base and of its inverse, as far as texts needed them; those of long texts are not kept.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT = 1 << 17


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers from 0 to ``n`` at least, modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, min(2 * n, _KEPT))
        got = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        with np.errstate(over="ignore"):
            for x in got:
                x[0] = 1
                np.multiply.accumulate(x, out=x)
        if size <= _KEPT:
            _POWERS[base] = got
    return got


class Rolling:
    """Polynomial hashes of any span of an array of code points, from prefix sums modulo 2**64.

    Code points are mixed first, so that the low bits of the sums are not those of the text.
    """

    def __init__(self, codes: np.ndarray, base: int = _P1):
        n = len(codes)
        up, self.down = _powers(base, n)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, _U)
            np.cumsum(mix(codes.astype(_U) + _U(base)) * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))

    def grams(self, q: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[q:] - self.sums[:-q]) * self.down[: len(self.sums) - q])


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` over each window of ``w`` values, by doubling."""
    size, out = 1, a
    while size * 2 <= w:
        out = f(out[:-size], out[size:])
        size *= 2
    return out if size == w else f(out[: len(out) - (w - size)], out[w - size :])


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each begins (with the end as last)."""
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return joined, at


def minima(grams: np.ndarray, begin: int, end: int, q: int, w: int) -> np.ndarray:
    """``minima_of_all`` of the one text [begin, end)."""
    return minima_of_all(grams[begin : end - q + 1], np.array([0, end - begin]), q, w) + begin


def minima_of_all(grams: np.ndarray, at: np.ndarray, q: int, w: int) -> np.ndarray:
    """Positions in the texts [at[n], at[n + 1]) that hold the least q-gram hash of some window of ``w`` q-grams of their text.

    Which positions these are depends on nothing further than ``w`` q-grams away; equal least values all count. So
    two texts with a stretch in common choose the same positions inside it, away from its ends.
    """
    if len(grams) < w:
        return np.empty(0, np.int64)
    pad = np.zeros(w - 1, grams.dtype)
    low = np.concatenate([pad, _slide(grams, w, np.minimum), pad])
    # windows that run over the end of a text
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
        low[w - 1 + max(begin, end - w - q + 2) : w - 1 + end] = 0
    return np.flatnonzero(grams == _slide(low, w, np.maximum))
