"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240101).integers(0, 1 << 64, 256, np.uint64)
_PLACES = np.random.default_rng(20240102).integers(0, 1 << 64, 64, np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the input changes half of the output."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _power(kind: str, n: int) -> np.ndarray:
    """1, b, b**2 ... modulo 2**64; b is the base, or its inverse."""
    have = _powers[kind]
    if len(have) < n:
        step = np.full(max(n, 1 << 20), _U(_BASE if kind == "up" else _BACK))
        step[0] = 1
        _powers[kind] = have = np.multiply.accumulate(step)
    return have[:n]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, and the position of each text's first word (with the total at the end).

    Words are runs of anything but space, tab and the line ends 0x0A to 0x0D. Null is an empty text.
    """
    return hash_words([(t or "").encode() for t in texts])


def hash_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts that are encoded already."""
    return located(raw)[:2]


def located(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the texts' bytes laid end to end, with where each word begins and ends in them."""
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    gap = _SPACE[data]
    first = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    last = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[data] * _power("up", len(data)), out=total[1:])
    hashes = mix((total[last] - total[first]) * _power("down", len(data))[first])
    begins = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return hashes, np.searchsorted(first, begins), data, first, last


def shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``size`` words of each text, and where each text's begin. A shorter text that isn't empty has one of all its words."""
    hashes, starts = words(texts)
    count = np.diff(starts)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begins = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(begins[-1]) - begins[owner] + starts[owner]
    end = starts[owner + 1]
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        out += np.where(at + k < end, padded[at + k] * _PLACES[k], _U(0))
    return mix(out), begins


def multiset(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, how often each occurs, and where each text's begin."""
    found, begins = shingles(texts, size)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(found)))
    return found[at], times, np.searchsorted(owner[at], np.arange(len(begins)))


def occurrences(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Each text's multiset as a sorted set: the k-th occurrence of a shingle is an element of its own, so that the
    Jaccard similarity of these sets is that of the multisets."""
    found, times, begins = multiset(texts, size)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    whole = mix(np.repeat(found, times) + nth.astype(np.uint64) * _U(_BASE))
    ends = np.concatenate([[0], np.cumsum(times)])[begins]
    return [np.sort(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
