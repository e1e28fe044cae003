"""SuperMinHash signatures of many sets at once.

Every element walks through its own random permutation of the signature's
places; in round ``j`` it offers ``j + r`` (``r`` uniform in [0, 1)) to the place
its permutation names. As each element spreads its offers over all places
without repeating one, the places' matches are negatively correlated and the
estimate has less variance than independent hashes give. A set is finished as
soon as every place holds less than ``j + 1``, for later offers are larger: sets
of some hundred elements need two rounds, not one per place.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
#: Rounds in which permutations are traced back over their swaps; later rounds keep them as rows.
_TRACED = 6
_FRACTION = _U(56)


def signatures(code: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """``places`` 64-bit values for each set; set ``i`` has the distinct hashes ``code[first[i]:first[i + 1]]``. Empty sets keep the largest value."""
    rows = len(first) - 1
    best = np.full((rows, places), np.iinfo(np.uint64).max, dtype=_U)
    row = np.repeat(np.arange(rows), np.diff(first))
    flat = best.reshape(-1)
    swaps: list[np.ndarray] = []
    order: np.ndarray | None = None
    for j in range(places):
        if not len(code):
            break
        offer = mix(code + _U((2 * j + 1) * _STEP & 0xFFFFFFFFFFFFFFFF))
        pick = mix(offer + _U(_STEP)) >> _U(32)
        k = (j + ((pick * _U(places - j)) >> _U(32))).astype(np.int64)
        if j < _TRACED:
            place = k.copy()
            for i in range(j - 1, -1, -1):
                was = swaps[i]
                place = np.where(place == i, was, np.where(place == was, i, place))
            swaps.append(k)
        else:
            if order is None:
                order = np.tile(np.arange(places, dtype=np.int16), (len(code), 1))
                every = np.arange(len(code))
                for i, was in enumerate(swaps):
                    order[every, was], order[every, i] = order[every, i], order[every, was].copy()
                swaps = []
            every = np.arange(len(code))
            place = order[every, k].astype(np.int64)
            order[every, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(flat, row * places + place, (_U(j) << _FRACTION) | (offer >> _U(8)))
        open_rows = best.max(axis=1) >= (_U(j + 1) << _FRACTION)
        on = open_rows[row]
        if not on.all():
            code, row = code[on], row[on]
            swaps = [s[on] for s in swaps]
            if order is not None:
                order = order[on]
    return best


def band_keys(best: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands of different number never share one."""
    rows, places = best.shape
    width = places // bands
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U) * _U(_STEP)), (rows, bands))
    for i in range(width):
        key = mix(key + best[:, i : bands * width : width] * _U(_STEP))
    return key
