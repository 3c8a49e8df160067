"""Rolling hashes and content-chosen anchors over one text's bytes or words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_ROW = np.random.default_rng(7).integers(1, 2**63, size=256, dtype=np.uint64) | _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    held = _powers.get(base)
    if held is None or len(held[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        held = tuple(np.concatenate((np.ones(1, dtype=_U), np.cumprod(np.full(size, b, dtype=_U)))) for b in (base, inverse))
        if size <= 1 << 21:
            _powers[base] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, from which :func:`span_hash` takes any span's hash."""
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * _power(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _power(base, len(sums))[1][starts])


def grams(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all spans of ``width`` values; empty if there are fewer."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, dtype=_U)
    return mix((sums[width:] - sums[:-width]) * _power(base, len(sums))[1][:n])


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_ROW[data], BYTE_BASE)


#: Bytes up to which a word's polynomial hash is taken. Modulo 2**64, texts made by doubling (Thue-Morse) have equal hashes whatever the base, from some thousand bytes on.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: longer words, of which there are few, are hashed one by one."""
    out = span_hash(byte_prefix(data), starts, ends, BYTE_BASE)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and 0x09 to 0x0D."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def sliding(h: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each run of ``width`` values; empty if there are fewer."""
    if len(h) < width:
        return h[:0]
    size = 1
    while 2 * size <= width:
        h = op(h[:-size], h[size:])
        size *= 2
    return op(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def anchors(gram_hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``width`` grams its least hash, and which grams are the least of some run that holds them.

    Equal runs have equal least hashes wherever they stand, so two equal windows are always found under the same hash.
    """
    least = sliding(gram_hashes, width, np.minimum)
    if not len(least):
        return least, np.zeros(len(gram_hashes), dtype=bool)
    around = np.zeros(len(least) + 2 * (width - 1), dtype=_U)
    around[width - 1 : width - 1 + len(least)] = least
    return least, sliding(around, width, np.maximum) == gram_hashes


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie within ``width`` of a start."""
    marks = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(marks[:n]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, as rows."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2)
