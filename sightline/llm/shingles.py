"""Word shingles as sorted arrays of 64-bit fingerprints, computed on whole texts."""

from __future__ import annotations

import numpy as np

_M = np.uint64
#: A fixed random value for every byte, and an odd multiplier with its inverse modulo 2**64.
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * _M(2) + _M(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, 2 * len(_POW[0]), 1 << 14)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POW[k] = np.cumprod(steps, dtype=np.uint64)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
        return x ^ (x >> _M(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct fingerprints of the runs of ``width`` words, sorted.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text of
    fewer words has its whole sequence as its one shingle; no word, no shingle.
    The fingerprint is a polynomial over the bytes of the words joined by one space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    power, inverse = _powers(len(joined) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[joined] * power[: len(joined)], out=total[1:])
        prints = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return np.unique(mix(prints))
