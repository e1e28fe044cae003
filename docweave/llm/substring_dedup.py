"""Substring dedup by prefix-partitioned suffix trees.

A repeat is a run of ``window`` words that also starts earlier. The trees hold the
suffixes that begin with whole windows.

1. Partition. Each window names a prefix of ``PREFIX`` words inside it: the one whose
   hash is least. Equal windows name the same prefix at the same place. A prefix that
   occurs once holds no repeat and its windows go no further. Windows below branching
   prefixes are dealt by prefix, and by a longer one, all their words, where a prefix
   has more than ``GROUP_SUFFIXES`` suffixes, so groups fit a task's memory.
2. Trees. A task gets its groups' words: one record for the neighbouring windows that
   share a prefix. Words become numbers by their bytes, each record ends in a
   terminator of its own, and prefix doubling sorts the suffixes of all windows. The
   lengths that neighbours have in common are the depths of the tree's internal nodes:
   below a node of ``window`` words or deeper stand the leaves of a repeat, and all
   but the earliest are marked. Marks that touch form the maximal repeats.
3. Marked starts go back to their documents, whose uncovered words are kept.

Hashes only deal and nominate; words decide. (Words of 16 bytes or more are known by
120 bits of a cryptographic digest.) A task first settles equal records of its own and
sends one of them, so a passage in a third of all documents reaches its group as one
record per sender; each task builds the trees of its share part by part.

Defined results: null, empty and blank texts have no words and keep the digest of
the empty string; order is by doc_id, then by a hash of the text, then by
position; rows that repeat id and text are one document and get equal rows; a
null doc_id comes before all others. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, shuffle_width
from .words import codes, distinct, give_back, keys, mix, run_codes, sliding_min, text_slices, words_of

WINDOW = 20
#: Words of a short prefix.
PREFIX = 8
#: Suffixes below one prefix that a task may hold, about; beyond, the prefix grows.
GROUP_SUFFIXES = 50_000
#: Prefixes that may grow: their hashes go to all tasks, in 8 bytes each. Beyond these the next largest stay short.
MOST_CROWDED = 2_000_000
#: Suffixes, and bytes of records, that a task gathers before it sends them on.
FLUSH, FLUSH_BYTES = 500_000, 24 << 20
#: Parts of a bucket whose trees are built one after the other.
PARTS = 8
#: doc_id that stands for null, below all others.
NO_ID = -(1 << 63)

_PACKED = "bucket int, flag boolean, n int, raw long, payload binary"
_LEAF = [("path", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("many", "<i4")]
_RECORD = [("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("n", "<i4"), ("size", "<i4"), ("part", "u1")]
_MARK = [("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("n", "<i4")]
_CROWD = [("path", "<u8"), ("many", "<i8")]


def _bucket(key, buckets: int):
    import numpy as np

    return ((mix(key) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _packed(records, to, flag: bool, texts: list | None = None) -> Iterator:
    """Records as rows of packed columns, with their texts behind, one row for each bucket that ``to`` names."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(to, kind="stable")
    records, to, rows = records[order], to[order], []
    cuts = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)]):
        if b > a:
            columns = [np.ascontiguousarray(records[f][a:b]).tobytes() for f in records.dtype.names]
            payload = b"".join(columns + ([texts[i] for i in order[a:b].tolist()] if texts is not None else []))
            rows.append((int(to[a]), flag, b - a, len(payload), pa.compress(payload, codec="zstd", asbytes=True)))
        if len(rows) == 256 or (rows and b == len(to)):
            types = (pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["bucket", "flag", "n", "raw", "payload"])
            rows = []


def _unpacked(row: tuple, kind: list) -> tuple:
    """Records of a packed row, and the bytes behind them."""
    import numpy as np
    import pyarrow as pa

    _, _, n, raw, payload = row
    payload = pa.decompress(payload, decompressed_size=raw, codec="zstd", asbytes=True)
    records, at = np.empty(n, dtype=kind), 0
    for f in records.dtype.names:
        size = n * records.dtype[f].itemsize
        records[f] = np.frombuffer(payload, dtype=records.dtype[f], count=n, offset=at)
        at += size
    return records, payload[at:]


def _by_bucket(batches: Iterator) -> Iterator:
    """Packed rows in lists, one for each bucket; rows come sorted by bucket."""
    give_back()
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "flag", "n", "raw", "payload"))))
    for _, own in itertools.groupby(rows, key=lambda row: row[0]):
        yield list(own)
    give_back()


def _dealt(packed: DataFrame) -> DataFrame:
    return packed.repartition(shuffle_width(packed.sparkSession), "bucket").sortWithinPartitions("bucket")


def _prefixes(words, window: int):
    """Starts of whole windows, for each the place of the prefix it names, and the codes of words and of prefixes."""
    import numpy as np

    code = codes(*keys(words))
    n = len(code)
    if n < window:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), code, code[:0]
    prefix = run_codes(code, min(PREFIX, window))
    low = np.uint64((1 << 32) - 1)
    ranked = (prefix & ~low) | np.arange(len(prefix), dtype=np.uint64)
    named = (sliding_min(ranked, window - min(PREFIX, window) + 1) & low).astype(np.int64)
    last = np.repeat(words.first[1:], np.diff(words.first)) - window  # last start inside the text, for each word
    start = np.flatnonzero(np.arange(len(named)) <= last[: len(named)])
    return start, named[start], code, prefix


def _placed(kind: list, batch, words, at):
    """Records with document, hash of its text and place in it, of word places ``at`` of a slice."""
    import numpy as np

    row = np.searchsorted(words.first, at, side="right") - 1
    made = np.zeros(len(at), dtype=kind)
    made["at"] = at - words.first[row]
    for field in ("doc", "tag"):
        made[field] = np.asarray(batch.column(field))[row]
    return made


def _in_order(leaves, path):
    """Places of leaves in order of path, document and start, whether each is the first of its path, and whether it differs from the one before (rows that repeat give equal leaves)."""
    import numpy as np

    order = np.lexsort((leaves["at"], leaves["tag"], leaves["doc"], path))
    own, path = leaves[order], path[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = path[1:] != path[:-1]
    other = new.copy()
    for field in ("doc", "tag", "at"):
        other[1:] |= own[field][1:] != own[field][:-1]
    return order, new, other


def _send_leaves(leaves, buckets: int) -> Iterator:
    """One leaf for each path, with their number; the later ones, flagged, are below a branching prefix for sure."""
    import numpy as np

    order, new, other = _in_order(leaves, leaves["path"])
    leaves, heads = leaves[order], np.flatnonzero(new)
    leaves["many"][heads] = np.add.reduceat(other.astype(np.int32), heads)
    yield from _packed(leaves[heads], _bucket(leaves["path"][heads], buckets), False)
    settled = leaves[other & ~new]
    yield from _marks(settled["doc"], settled["tag"], settled["at"], np.ones(len(settled), dtype=np.int32), buckets)


def _marks(doc, tag, at, n, buckets: int) -> Iterator:
    """Flagged marks, dealt by document."""
    import numpy as np

    marks = np.empty(len(doc), dtype=_MARK)
    for f, values in zip(("doc", "tag", "at", "n"), (doc, tag, at, n)):
        marks[f] = values
    yield from _packed(marks, _bucket(mix(marks["doc"].astype(np.uint64)) + marks["tag"].astype(np.uint64), buckets), True)


def _branching(batches: Iterator, most: int, buckets: int) -> Iterator:
    """Marks of leaves whose path others have, too, and (without flag) the paths of more than ``most`` leaves."""
    import numpy as np

    for rows in _by_bucket(batches):
        yield from _passed([row for row in rows if row[1]])
        waiting = [_unpacked(row, _LEAF)[0] for row in rows if not row[1]]
        if not waiting:
            continue
        leaves = np.concatenate(waiting)
        order, new, other = _in_order(leaves, leaves["path"])
        leaves, heads = leaves[order], np.flatnonzero(new)
        total = np.add.reduceat(leaves["many"].astype(np.int64), heads)
        crowd = np.empty(int((total > most).sum()), dtype=_CROWD)
        crowd["path"], crowd["many"] = leaves["path"][heads][total > most], total[total > most]
        yield from _packed(crowd, np.zeros(len(crowd), dtype=np.int64), False)
        branches = (np.add.reduceat(other.astype(np.int64), heads) > 1) | (np.maximum.reduceat(leaves["many"], heads) > 1)
        found = leaves[np.repeat(branches, np.diff(np.append(heads, len(leaves)))) & other]
        yield from _marks(found["doc"], found["tag"], found["at"], np.ones(len(found), dtype=np.int32), buckets)


def _passed(rows: list) -> Iterator:
    """Packed rows as they are."""
    import pyarrow as pa

    if rows:
        types = (pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["bucket", "flag", "n", "raw", "payload"])


def _send_records(records, deal, texts: list, buckets: int) -> Iterator:
    """The earliest of equal records; the windows of later ones are settled and go on as marks."""
    import numpy as np

    first: dict[bytes, int] = {}
    order = np.lexsort((records["at"], records["tag"], records["doc"]))
    which = np.fromiter((first.setdefault(texts[i], i) for i in order.tolist()), dtype=np.int64, count=len(order))
    own = order[which == order]
    yield from _packed(records[own], _bucket(deal[own], buckets), False, [texts[i] for i in own.tolist()])
    later, earliest = records[order], records[which]
    other = np.zeros(len(order), dtype=bool)
    for field in ("doc", "tag", "at"):
        other |= later[field] != earliest[field]
    later = later[other]
    yield from _marks(later["doc"], later["tag"], later["at"], later["n"], buckets)


class SuffixTree:
    """Suffixes of some records in order, and the depth at which each parts from the one before.

    ``starts`` are the places of suffixes among the numbers of all words, where each
    record ends in a terminator of its own. ``ranks[j]`` orders the runs of ``2**j``
    words, each made of two runs half as long.
    """

    def __init__(self, numbers, starts, window: int):
        import numpy as np

        self.ranks, length = [numbers.astype(np.uint64)], 1
        while 2 * length <= window:
            rank = self.ranks[-1]
            pair = (rank[:-length] << np.uint64(32)) | rank[length:]
            # runs that reach over the end are equal to none
            tail = len(numbers) + np.arange(length, dtype=np.uint64)
            self.ranks.append(np.concatenate([np.unique(pair, return_inverse=True)[1].astype(np.uint64), tail]))
            length *= 2
        # a window is put together from runs of falling length
        path, at, rest = None, starts, window
        for j in range(len(self.ranks) - 1, -1, -1):
            if rest >= 1 << j:
                own = self.ranks[j][at]
                path = own if path is None else np.unique((path << np.uint64(32)) | own, return_inverse=True)[1].astype(np.uint64)
                at, rest = at + (1 << j), rest - (1 << j)
        self.starts, self.path = starts, path

    def depths(self, order):
        """Words that each suffix has in common with the one before it in ``order``, as far as the ranks reach (twice the longest run, less one)."""
        import numpy as np

        at = self.starts[order]
        a, b = at[:-1].copy(), at[1:].copy()
        depth = np.zeros(len(a), dtype=np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[j]
            same = rank[a] == rank[b]
            depth[same] += 1 << j
            a[same] = np.minimum(a[same] + (1 << j), len(rank) - 1)
            b[same] = np.minimum(b[same] + (1 << j), len(rank) - 1)
        return np.concatenate([[0], depth])


def _repeats(batches: Iterator, window: int, buckets: int) -> Iterator:
    """Marks of all leaves but the earliest below nodes of ``window`` words or deeper."""
    import numpy as np

    for rows in _by_bucket(batches):
        yield from _passed([row for row in rows if row[1]])
        parts = [_unpacked(row, _RECORD) for row in rows if not row[1]]
        rows.clear()
        if not parts:
            continue
        records = np.concatenate([p for p, _ in parts])
        texts = []
        for own, blob in parts:
            ends = np.cumsum(own["size"].astype(np.int64)).tolist()
            texts += [blob[a:b] for a, b in zip([0, *ends], ends)]
        parts.clear()
        for part in range(PARTS):
            own = np.flatnonzero(records["part"] == part)
            if len(own):
                yield from _repeats_of(records[own], [texts[i] for i in own.tolist()], window, buckets)


def _repeats_of(records, texts: list, window: int, buckets: int) -> Iterator:
    """Marks for some records and the texts of their words."""
    import numpy as np

    words = words_of(texts)
    _, where, which = distinct(*keys(words))
    # a terminator behind each record: numbers that no word and no other record has
    count = np.diff(words.first)
    begin = words.first[:-1] + np.arange(len(records))
    numbers = np.empty(len(which) + len(records), dtype=np.int64)
    numbers[np.arange(len(which)) + np.repeat(np.arange(len(records)), count)] = which
    numbers[begin + count] = len(where) + np.arange(len(records))
    row = np.repeat(np.arange(len(records)), records["n"])
    within = np.arange(len(row)) - np.repeat(np.cumsum(records["n"]) - records["n"], records["n"])
    tree = SuffixTree(numbers, begin[row] + within, window)
    leaves = np.empty(len(row), dtype=_MARK)
    leaves["doc"], leaves["tag"], leaves["at"] = records["doc"][row], records["tag"][row], records["at"][row] + within
    order, _, other = _in_order(leaves, tree.path)
    deep = tree.depths(order) >= window
    yield from _runs(leaves[order][deep & other], buckets)


def _runs(marks, buckets: int) -> Iterator:
    """Marks that follow one another as one."""
    import numpy as np

    marks = marks[np.lexsort((marks["at"], marks["tag"], marks["doc"]))]
    new = np.ones(len(marks), dtype=bool)
    new[1:] = (marks["doc"][1:] != marks["doc"][:-1]) | (marks["tag"][1:] != marks["tag"][:-1]) | (marks["at"][1:] - marks["at"][:-1] > 1)
    heads = np.flatnonzero(new)
    if len(heads):
        last = np.append(heads[1:], len(marks)) - 1
        yield from _marks(marks["doc"][heads], marks["tag"][heads], marks["at"][heads], marks["at"][last] - marks["at"][heads] + 1, buckets)


_BY_DOC = "doc long, tag int, starts binary"
_START = [("at", "<i4"), ("n", "<i4")]


def _by_document(batches: Iterator) -> Iterator:
    """One row for each document of the marks that were dealt here: places and how many follow from each."""
    import numpy as np
    import pyarrow as pa

    for rows in _by_bucket(batches):
        marks = np.concatenate([_unpacked(row, _MARK)[0] for row in rows])
        marks = marks[np.lexsort((marks["at"], marks["tag"], marks["doc"]))]
        cuts = np.flatnonzero((np.diff(marks["doc"]) != 0) | (np.diff(marks["tag"]) != 0)) + 1
        bounds = [0, *cuts.tolist(), len(marks)]
        runs = np.empty(len(marks), dtype=_START)
        runs["at"], runs["n"] = marks["at"], marks["n"]
        for i in range(0, len(bounds) - 1, 2_000):
            part = bounds[i : i + 2_001]
            first = np.array(part[:-1])
            starts = [runs[a:b].tobytes() for a, b in zip(part, part[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(marks["doc"][first]), pa.array(marks["tag"][first]), pa.array(starts, type=pa.binary())], names=["doc", "tag", "starts"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (never null), tag (a hash that tells texts of one id apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(text).alias("tag"), text.alias("text"))


def repeated_starts(keyed: DataFrame, window: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """doc, tag and ``starts`` (packed places and lengths) of runs of windows that also start earlier."""
    import numpy as np

    buckets = shuffle_width(keyed.sparkSession)

    def suffixes(batches: Iterator) -> Iterator:
        import numpy as np

        held, n = [], 0
        for batch, texts in text_slices(batches):
            words = words_of(texts)
            _, named, _, prefix = _prefixes(words, window)
            at = np.unique(named)
            leaves = _placed(_LEAF, batch, words, at)
            leaves["path"], leaves["many"] = prefix[at], 1
            held.append(leaves)
            n += len(at)
            if n >= FLUSH:
                yield from _send_leaves(np.concatenate(held), buckets)
                held, n = [], 0
        if n:
            yield from _send_leaves(np.concatenate(held), buckets)

    def paths(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "flag", "n", "raw", "payload"))):
                crowd, _ = _unpacked(row, _CROWD)
                yield pa.RecordBatch.from_arrays([pa.array(crowd["path"].view(np.int64)), pa.array(crowd["many"])], names=["path", "many"])

    def windows(batches: Iterator) -> Iterator:
        import numpy as np

        held, n = [], 0
        crowded = spread.value
        for batch, texts in text_slices(batches):
            words = words_of(texts)
            start, named, code, prefix = _prefixes(words, window)
            if not len(start):
                continue
            branches = np.zeros(len(code), dtype=bool)
            for first, count, own in zip(words.first, np.diff(words.first), batch.column("starts").to_pylist()):
                at = np.frombuffer(own, dtype=_START)["at"]
                branches[first + at[at < count]] = True
            start, named = start[branches[named]], named[branches[named]]
            if not len(start):
                continue
            full = crowded[np.minimum(np.searchsorted(crowded, prefix[named]), len(crowded) - 1)] == prefix[named] if len(crowded) else np.zeros(len(named), dtype=bool)
            # neighbouring windows that name one prefix form a record, unless it is crowded
            new = np.ones(len(start), dtype=bool)
            new[1:] = (named[1:] != named[:-1]) | (start[1:] != start[:-1] + 1) | full[1:]
            heads = np.flatnonzero(new)
            records = _placed(_RECORD, batch, words, start[heads])
            records["n"] = np.diff(np.append(heads, len(start)))
            deal = np.where(full[heads], run_codes(code, window)[start[heads]], prefix[named[heads]])
            records["part"] = mix(deal) & np.uint64(PARTS - 1)  # other bits than those of the bucket
            begin, end = words.begin[start[heads]], words.end[start[heads] + records["n"] + window - 2]
            records["size"] = end - begin
            held.append((records, deal, [words.data[a:b] for a, b in zip(begin.tolist(), end.tolist())]))
            n += int((end - begin).sum())
            if n >= FLUSH_BYTES:
                yield from _send_records(np.concatenate([r for r, _, _ in held]), np.concatenate([d for _, d, _ in held]), sum((t for _, _, t in held), []), buckets)
                held, n = [], 0
        if held:
            yield from _send_records(np.concatenate([r for r, _, _ in held]), np.concatenate([d for _, d, _ in held]), sum((t for _, _, t in held), []), buckets)

    branching = materialize(_dealt(keyed.mapInArrow(suffixes, _PACKED)).mapInArrow(lambda b: _branching(b, group_suffixes, buckets), _PACKED), "branching")
    large = branching.filter("not flag").mapInArrow(paths, "path long, many long").orderBy(F.desc("many"), "path").limit(MOST_CROWDED)
    crowded = np.sort(np.array([r.path for r in large.select("path").collect()], dtype=np.int64).view(np.uint64))
    spread = keyed.sparkSession.sparkContext.broadcast(crowded)  # at most MOST_CROWDED numbers
    below = keyed.join(_dealt(branching.filter("flag")).mapInArrow(_by_document, _BY_DOC), ["doc", "tag"]).select("doc", "tag", "text", "starts").mapInArrow(windows, _PACKED)
    return _dealt(_dealt(below).mapInArrow(lambda b: _repeats(b, window, buckets), _PACKED)).mapInArrow(_by_document, _BY_DOC)


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with ``keep_text`` also the kept words as ``text``."""
    keyed = _keyed(docs)
    marked = repeated_starts(keyed, window, group_suffixes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def keep(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch, texts in text_slices(batches):
            rows = []
            for doc, text, starts in zip(batch.column("doc").to_pylist(), texts, batch.column("starts").to_pylist()):
                words = text.split()
                n = len(words)
                if starts:
                    cover = np.zeros(n + 1, dtype=np.int64)
                    runs = np.frombuffer(starts, dtype=_START)
                    np.add.at(cover, runs["at"], 1)
                    np.add.at(cover, np.minimum(runs["at"] + runs["n"] - 1 + window, n), -1)
                    words = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
                kept = b" ".join(words)
                rows.append((None if doc == NO_ID else doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8")] if keep_text else [])))
            columns = list(zip(*rows)) or [()] * (4 + keep_text)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + keep_text])

    return keyed.join(marked, ["doc", "tag"], "left").select("doc", "text", "starts").mapInArrow(keep, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
