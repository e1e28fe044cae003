"""Words of many texts at once, as numpy arrays over their bytes.

Words are runs of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``).
A word's *key* has 128 bits: a word of up to 15 bytes is its own key (bytes and
length), a longer one is known by 120 bits of its BLAKE2b digest. Words are told
apart by keys alone; the 64-bit *codes* made from them only nominate, and whoever
uses codes compares words afterwards. No Python code runs per short word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_U = np.uint64
#: Bytes of a text that are worked on at once, about.
SLICE_BYTES = 2_000_000
#: Longest word that is its own key.
_SHORT = 15
#: Stands behind the texts, so that 16 bytes can be read from any word's start.
PAD = bytes(16)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others (the splitmix64 finisher, a public mixing function)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words(NamedTuple):
    """Words of a slice of texts: where each begins and ends in ``data``, and the first word of each text (and the end). ``folded`` is ``data``, with A-Z in lower case where that was asked for, and some padding."""

    data: bytes
    folded: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(texts: list[bytes | None], fold: bool = False) -> Words:
    """Words of all texts; ``fold`` lower-cases A-Z in their keys."""
    texts = [t or b"" for t in texts]
    data = b"\n".join([b"", *texts, PAD])
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw[: -len(PAD)]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    begin, end = edge[0::2], edge[1::2]
    return Words(data, _FOLD[raw] if fold else raw, begin, end, np.searchsorted(begin, starts))


def part_tail(words: Words) -> Words:
    """Words with a full stop or comma after a last letter (of ASCII or Latin-1) taken as a word of its own."""
    raw = words.folded
    last = raw[words.end - 1]
    at = np.maximum(words.end - 2, 0)
    before, ahead = raw[at] | 0x20, raw[at]
    letter = (before >= 0x61) & (before <= 0x7A) & (ahead < 0x80)
    latin = (raw[np.maximum(at - 1, 0)] == 0xC3) & (ahead >= 0x80) & (ahead != 0x97) & (ahead != 0xB7)
    cut = ((last == 0x2E) | (last == 0x2C)) & (words.end - words.begin > 1) & (letter | latin)
    if not cut.any():
        return words
    n = np.cumsum(cut) - cut + np.arange(len(cut))  # where each word goes
    begin, end = (np.empty(len(cut) + int(cut.sum()), dtype=np.int64) for _ in range(2))
    begin[n], end[n] = words.begin, words.end - cut
    begin[n[cut] + 1], end[n[cut] + 1] = words.end[cut] - 1, words.end[cut]
    return words._replace(begin=begin, end=end, first=np.append(n, len(begin))[words.first])


def keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The key of every word, as two 64-bit numbers."""
    size = words.end - words.begin
    eight = np.ndarray((len(words.folded) - 7,), "<u8", words.folded, strides=(1,))
    low = eight[words.begin] & _MASK[np.minimum(size, 8)]
    high = eight[words.begin + 8] & _MASK[np.clip(size - 8, 0, 7)]
    high |= np.minimum(size, _SHORT).astype(_U) << _U(56)
    wide = np.flatnonzero(size > _SHORT)
    if len(wide):
        view = memoryview(words.folded)
        digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(words.begin[wide].tolist(), words.end[wide].tolist())])
        pair = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
        low[wide], high[wide] = pair[:, 0], pair[:, 1] | _U(0xFF << 56)
    return low, high


def codes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit code of each key, for nominating."""
    return mix(low ^ mix(high + _U(0x9E3779B97F4A7C15)))


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all keys, one place for each different key, and which of those each key is. Equal codes of different keys do no harm."""
    code = codes(low, high)
    found, which = np.unique(code, return_inverse=True)
    where = np.empty(len(found), dtype=np.int64)
    where[which] = np.arange(len(code))  # any place will do, which spares a stable sort
    if not (np.array_equal(low[where][which], low) and np.array_equal(high[where][which], high)):
        _, where, which = np.unique(np.rec.fromarrays([low, high]), return_index=True, return_inverse=True)
    return code, where, which


def run_codes(code: np.ndarray, k: int) -> np.ndarray:
    """Code of every run of ``k`` words, also of runs that reach over the end of a text; one for each start."""
    have = 1
    while have < k and len(code):
        by = min(have, k - have)
        code = mix(code[: max(len(code) - by, 0)] * _U(0xD6E8FEB86659FD93) + code[by:])
        have += by
    return code


def run_ranks(which: np.ndarray, k: int) -> np.ndarray:
    """Numbers that tell every run of ``k`` words apart from all different ones of this slice, given such numbers of words; one for each start."""
    rank, have = which.astype(_U), 1
    while have < k and len(rank):
        by = min(have, k - have)
        pair = (rank[: max(len(rank) - by, 0)] << _U(32)) | rank[by:]
        have += by
        rank = np.unique(pair, return_inverse=True)[1].astype(_U) if have < k else pair
    return rank


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def give_back() -> None:
    """Return freed memory to the system, so that a reused worker does not keep the peak of its last task."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batches: Iterator, most_bytes: int = SLICE_BYTES) -> Iterator:
    """Record batches in slices of bounded text, each with its texts as bytes. What the task before left behind is given back first."""
    import pyarrow as pa

    from .tokens import in_slices

    give_back()
    for whole in batches:
        for batch in in_slices(whole, "text", most_bytes, 20_000):
            yield batch, batch.column("text").cast(pa.large_binary()).to_pylist()
        del whole
    give_back()
