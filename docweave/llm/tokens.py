"""Public tokenizers inside Spark tasks.

A text is cut only where the tokenizer itself can never join two sides, each
distinct chunk is encoded once by the library, and a text's ids are the chunks'
ids in a row. Chunks are told apart by their bytes, so that is exact, and most
chunks of a corpus repeat.
"""

from __future__ import annotations

import array
import os
from collections.abc import Callable, Iterable, Iterator

#: Bytes of chunks and results that one Python worker keeps, about.
CACHE_BYTES = 64 << 20
#: Bytes that an entry takes besides its chunk and its result.
_ENTRY = 160


class Cache:
    """Results by chunk in two generations: when the younger one holds half of the bytes allowed, it takes the place of the older one, so what recurs stays."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held = most, 0
        self.young: dict = {}
        self.old: dict = {}

    def results(self, chunks: list, make: Callable[[list], list], size: Callable = len) -> list:
        """One result for each of some distinct chunks; ``make`` gives those that are not kept."""
        young, old = self.young, self.old
        missing = [c for c in chunks if c not in young]
        kept = [c for c in missing if c in old]
        new = [c for c in missing if c not in old] if kept else missing
        if kept:
            again = list(map(old.__getitem__, kept))
            young.update(zip(kept, again))
            self.held += sum(map(len, kept)) + sum(map(size, again)) + _ENTRY * len(kept)
        if new:
            made = make(new)
            young.update(zip(new, made))
            self.held += sum(map(len, new)) + sum(map(size, made)) + _ENTRY * len(new)
        found = list(map(young.__getitem__, chunks))
        if self.held > self.most // 2:
            self.old, self.young, self.held = young, {}, 0
        return found


def load_tokenizer(path: str):
    """The library's tokenizer for a .json file; one thread, as Spark shares out the work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)



class WordIds:
    """Ids of whole texts under a lower-casing tokenizer that drops white space.

    Such a tokenizer never joins what stands on both sides of ASCII white space,
    nor a letter with the full stop or comma that ends its word, so texts are cut
    there. Each distinct word (by its bytes, A-Z in lower case) is encoded by the
    library, and the texts' ids are gathered from those by position.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import numpy as np

        self.tokenizer = load_tokenizer(path)
        self.cache = Cache(cache_bytes)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Words of letters alone are one piece each, so they are encoded many at a time and told apart by the tokens that close a word."""
        import numpy as np

        found: dict[str, bytes] = {}
        plain = [w for w in words if w.isalpha()]
        for at in range(0, len(plain), 50_000):
            part = plain[at : at + 50_000]
            lines = [" ".join(part[i : i + 500]) for i in range(0, len(part), 500)]
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                data, stops = ids.tobytes(), (ends * 4).tolist()
                found.update(zip(part, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops))))
        rest = [w for w in words if w not in found]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            found.update((w, array.array("I", e.ids).tobytes()) for w, e in zip(part, encoded))
        return list(map(found.__getitem__, words))

    def encode(self, texts: list[bytes | None], end_id: int | None = None):
        """Ids of all texts in a row, as 32-bit numbers, and where each text's begin (and the end). ``end_id`` closes each text."""
        import numpy as np

        from .words import distinct, keys, part_tail, words_of

        words = part_tail(words_of(texts, fold=True))
        _, where, which = distinct(*keys(words))
        data = words.folded.tobytes()
        chunks = [data[a:b] for a, b in zip(words.begin[where].tolist(), words.end[where].tolist())]
        parts = self.cache.results(chunks, lambda new: self.look_up([c.decode("utf-8") for c in new]))
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) >> 2
        begin = np.cumsum(size) - size
        each = size[which]
        stop = np.cumsum(each)
        out = ids[np.repeat(begin[which] - (stop - each), each) + np.arange(stop[-1] if len(stop) else 0)]
        first = np.concatenate([[0], stop])[words.first]
        if end_id is not None:
            out = np.insert(out, first[1:], end_id)
            first = first + np.arange(len(first))
        return out, first


_WORKERS: dict[tuple, object] = {}


def worker_local(key: tuple, make: Callable[[], object]):
    """One object per Python worker, kept over its tasks."""
    if key not in _WORKERS:
        _WORKERS[key] = make()
    return _WORKERS[key]


def in_slices(batch, column: str, most_bytes: int = 4_000_000, most_rows: int = 2_000) -> Iterator:
    """A record batch in slices of bounded text, so that long texts do not pile up."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total = np.cumsum(np.asarray(pa.array(sizes).to_numpy(zero_copy_only=False), dtype=np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = total[at - 1] if at else 0
        end = int(np.searchsorted(total, base + most_bytes, side="right"))
        end = min(max(end, at + 1), at + most_rows, n)
        yield batch.slice(at, end - at)
        at = end
