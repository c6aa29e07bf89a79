"""DartMinHash signatures of weighted sets, such as the word shingles of a text with their counts.

An element with weight w is the region [0, w) of a weight axis, over a rank axis. The weight axis is cut into slots:
[0, 1), [1, 2), [2, 4) and so on, each twice as wide as all before it reach. Darts are thrown, by hashing
alone, into each slot over the rank axis, cut into fixed intervals (shorter ones for wider slots, so that all have
the same few darts on average); how many fall into one is a Poisson draw, and those of the last slot that fall beyond
w are left out. Each dart belongs to one coordinate of the signature, and a coordinate keeps its earliest dart. Two
sets agree in a coordinate with the probability of their weighted Jaccard similarity, the sum of the smaller
weights over that of the larger ones. About k ln k + 2k darts are thrown for k coordinates, however long the text and
large the weights; an element of weight w has 1 + log2(w) slots. Weights below 1 cost as much as 1.

For exact checks the same multiset is an array of *cells*: the j-th occurrence of a shingle is a cell of its own.
"""

from __future__ import annotations

import math

import numpy as np

SHINGLE = 5
BANDS, ROWS = 24, 6
COORDINATES = BANDS * ROWS

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
#: The rank axis: [0, 2**-7), doubling up to 1, then unit intervals.
_FIRST = 7
_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, "u8"), dtype="u8")
_MULTIPLIERS = (np.arange(1, SHINGLE + 1, dtype="u8") * _U(0xA24BAED4963EE407)) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def interval(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of the rank intervals with these numbers."""
    low = np.where(m == 0, 0.0, np.exp2(np.minimum(m, _FIRST + 1) - 1.0 - _FIRST)) + np.maximum(m - _FIRST - 1, 0)
    width = np.where(m == 0, 2.0**-_FIRST, np.exp2(np.minimum(m - 1.0, _FIRST) - _FIRST))
    return low, width


def _poisson_thresholds(width: float, most: int = 14) -> np.ndarray:
    """Hash values from which a cell has at least 1, 2, ... darts in an interval."""
    term, total, out = math.exp(-width), 0.0, []
    for j in range(most):
        total += term
        out.append(min(int(total * 2.0**64), 2**64 - 1))
        term *= width / (j + 1)
    return np.array(out, "u8")


_THRESHOLDS = np.array([_poisson_thresholds(float(interval(np.array(m))[1])) for m in range(_FIRST + 2)])


def shingle_hashes(words: bytes) -> np.ndarray:
    """Hashes of the five-word windows of words joined by single blanks; fewer words are one window."""
    raw = np.frombuffer(words, "u1")
    if not len(raw):
        return np.zeros(0, "u8")
    gaps = raw == 32
    starts = np.concatenate([[0], np.flatnonzero(gaps) + 1])
    lengths = np.diff(np.concatenate([starts, [len(raw) + 1]]))
    place = np.arange(len(raw)) - np.repeat(starts, lengths)[: len(raw)]
    value = (raw.astype("u8") + _U(1)) * _POWERS[place & 4095] + (place >> 12).astype("u8")
    value[gaps] = 0
    word = mix(np.add.reduceat(value, starts) + lengths.astype("u8"))
    n = min(SHINGLE, len(word))
    total = np.zeros(len(word) - n + 1, "u8")
    for j in range(n):
        total += word[j : len(word) - n + 1 + j] * _MULTIPLIERS[j]
    return mix(total + _U(n))


def shingles(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the different shingles, and how often each occurs."""
    return np.unique(shingle_hashes(words), return_counts=True)


def cells(words: bytes) -> np.ndarray:
    """Sorted hashes of the (shingle, occurrence) cells; the first occurrence has the shingle's own hash."""
    h = np.sort(shingle_hashes(words))
    if len(h) < 2:
        return h
    new = np.concatenate([[True], h[1:] != h[:-1]])
    starts = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(h)]])))
    return np.sort(np.where(nth > 0, mix(h + nth.astype("u8") * _GOLD), h)) if nth.any() else h


def slots(element: np.ndarray, weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """The slots of elements, those of one place together: hashes, the elements' weights, start and width."""
    out, start, width = [], 0.0, 1.0
    while len(element):
        hashes = element if not out else mix(element + _U((len(out) * int(_GOLD)) % 2**64))
        out.append((hashes, weight, start, width))
        start, width = start + width, width if not start else 2 * width
        more = weight > start
        element, weight = element[more], weight[more]
    return out


def _intervals(reach: float) -> int:
    """Number of rank intervals that begin below the reach."""
    return int(_FIRST + 1 + math.ceil(reach - 1)) if reach > 1 else int(_FIRST + 1 - math.floor(-math.log2(max(reach, 2.0**-_FIRST))))


def signature(element: np.ndarray, weight: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """The id of the earliest dart of each coordinate. Elements are different 64-bit hashes, weights are real (1 without
    any); those of weight 0 or less are left out, and a set without others raises an error."""
    weight = np.ones(len(element)) if weight is None else np.asarray(weight, "f8")
    element, weight = element[weight > 0], weight[weight > 0]
    if not len(element) or not np.isfinite(weight).all():
        raise ValueError("A signature needs elements with finite weights above 0")
    ids, rank = np.zeros(k, "u8"), np.full(k, np.inf)
    parts = slots(element, weight)
    done, reach = [0] * len(parts), (k * math.log(k) + 2 * k) / float(weight.sum())
    while True:
        for i, (hashes, whole, start, width) in enumerate(parts):
            upto = max(done[i], _intervals(reach * width))
            for first in range(done[i], upto, step := max(1, 20_000 // len(hashes))):
                _throw(hashes, whole, start, width, np.arange(first, min(upto, first + step)), k, ids, rank)
            done[i] = upto
        # no dart is missing before the first interval that was not thrown
        known = min(float(interval(np.array(n))[0]) / part[3] for n, part in zip(done, parts))
        if rank.max() <= known:
            return ids
        reach = max(reach * 1.5, known)


def _throw(cell: np.ndarray, weight: np.ndarray, start: float, slot: float, numbers: np.ndarray, k: int, ids: np.ndarray, rank: np.ndarray) -> None:
    """Throw the darts of some intervals of slots with this start and width; ids and rank keep the earliest of each coordinate."""
    low, width = interval(numbers)
    limits = _THRESHOLDS[np.minimum(numbers, _FIRST + 1)]
    seed = mix((numbers.astype("u8") + _U(1)) * _GOLD)
    drawn = mix(cell[:, None] ^ seed[None, :])
    at_cell, at_interval = np.nonzero(drawn >= limits[None, :, 0])
    if not len(at_cell):
        return
    value = drawn[at_cell, at_interval]
    count = (value[:, None] >= limits[at_interval]).sum(axis=1)
    which = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    dart = mix(value[which] + (nth.astype("u8") + _U(1)) * _GOLD)
    if (weight < start + slot).any():
        height = start + slot * ((mix(dart + _M1) >> _U(11)) * 2.0**-53)
        inside = height < weight[at_cell[which]]
        dart, which = dart[inside], which[inside]
        if not len(dart):
            return
    coordinate = ((dart >> _U(33)) % _U(k)).astype("i8")
    place = mix(dart ^ _GOLD)
    ranks = (low[at_interval[which]] + width[at_interval[which]] * ((place >> _U(11)) * 2.0**-53)) / slot
    order = np.lexsort((ranks, coordinate))
    c = coordinate[order]
    head = order[np.concatenate([[True], c[1:] != c[:-1]])]
    won = head[ranks[head] < rank[coordinate[head]]]
    rank[coordinate[won]] = ranks[won]
    ids[coordinate[won]] = dart[won]


def band_keys(ids: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per band, different bands apart."""
    key = np.arange(1, bands + 1, dtype="u8") * _GOLD
    for column in ids.reshape(bands, rows).T:
        key = mix(key ^ column) + _GOLD
    return mix(key).view("i8")


def normalised(text: str | None) -> bytes:
    """Lower-case words joined by single blanks."""
    return " ".join(text.lower().split()).encode("utf-8", "replace") if text else b""


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted cell arrays."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)
