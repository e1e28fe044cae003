"""Best-fit packing planned on a histogram of lengths.

Documents become token ids, closed by an end id; only those longer than a
sequence are cut. The plan needs counts per length alone, so at most
``capacity`` rows come to the driver, whatever the corpus holds. Best fit runs
over those counts from the longest length down: all sequences with the same
space left form one range of numbers, a length's pieces take the ranges with
the least sufficient space, many at a time, and what finds none opens new
sequences. Each decision is one *slot run* (length, first rank, number, how many
per sequence, first sequence, offset); there are a few per length. Documents then
take their slots by rank within their length.

Ranks come from two levels (buckets of ids, then inside a bucket), so a length
that a third of all pieces share never meets in one task.

Defined results: null and empty texts are the end id alone; repeated rows are
packed as often as they come; an empty table gives no rows. Columns other than
id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import buckets_for, materialize
from .tokens import WordIds, tokenizer_path, worker_local
from .words import text_slices

CAPACITY = 4096
END_ID = 1
#: Pieces of all lengths that one rank bucket holds, about; a length's share of a bucket meets in one task.
BUCKET_ROWS = 5_000


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; with ``keep_ids`` also its ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = worker_local(("word ids", tokenizer), lambda: WordIds(tokenizer))
        for batch, texts in text_slices(batches):
            ids, first = words.encode(texts, end_id)
            ids, first = np.ascontiguousarray(ids, dtype="<u4"), first.tolist()
            view, rows = memoryview(ids).cast("B"), []
            for doc_id, begin, end in zip(batch.column("doc_id").to_pylist(), first, first[1:]):
                for piece, at in enumerate(range(begin, end, capacity)):
                    stop = min(at + capacity, end)
                    rows.append((doc_id, piece, at - begin, stop - at, zlib.crc32(view[4 * at : 4 * stop]), *([ids[at:stop].astype(np.int32)] if keep_ids else [])))
            columns = list(zip(*rows)) or [()] * (5 + keep_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class SlotRun(NamedTuple):
    """Pieces of one length from rank ``first`` on: ``each`` of them in each sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    number: int
    each: int
    sequence: int
    offset: int


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[SlotRun]:
    """Best fit, longest lengths first, over counts of lengths."""
    runs: list[SlotRun] = []
    space: list[int] = []  # sorted: spaces left that some sequences have
    ranges: dict[int, list[tuple[int, int]]] = {}  # of sequence numbers, by space left
    opened = 0

    def give(left: int, start: int, n: int) -> None:
        if left and n:
            if left not in ranges:
                bisect.insort(space, left)
                ranges[left] = []
            ranges[left].append((start, n))

    for length in sorted(counts, reverse=True):
        todo, first = counts[length], 0
        while todo:
            k = bisect.bisect_left(space, length)
            if k < len(space):
                left = space[k]
                start, n = ranges[left].pop()
                if not ranges[left]:
                    del ranges[left], space[k]
            else:
                left, start, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            each = left // length
            full = min(n, todo // each)
            if full:
                runs.append(SlotRun(length, first, full * each, each, start, capacity - left))
                give(left - each * length, start, full)
                first, todo = first + full * each, todo - full * each
            if full < n and todo:
                runs.append(SlotRun(length, first, todo, todo, start + full, capacity - left))
                give(left - todo * length, start + full, 1)
                first, todo, full = first + todo, 0, full + 1
            give(left, start + full, n - full)
    return runs


def rank_within_length(pieces: DataFrame, rows: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` with ``rank``: a number from 0 on within each length, without gaps."""
    n = buckets_for(rows, bucket_rows)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return dealt.withColumn("inside", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"]).select(*pieces.columns, (F.col("base") + F.col("inside")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece, ids_crc32 and length) with sequence_id and offset.

    ``pieces`` is read three times, so give a stored table.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    by_length: dict[int, list[SlotRun]] = {}
    for run in plan_slots(counts, capacity):
        by_length.setdefault(run.length, []).append(run)
    ranked = rank_within_length(pieces, sum(counts.values()))
    names = pieces.columns

    def take(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        runs = {length: np.array(x, dtype=np.int64) for length, x in by_length.items()}
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for one in np.unique(length):
                mine = np.flatnonzero(length == one)
                table = runs[int(one)]
                own = table[np.searchsorted(table[:, 1], rank[mine], side="right") - 1]
                at = rank[mine] - own[:, 1]
                sequence[mine] = own[:, 4] + at // own[:, 3]
                offset[mine] = own[:, 5] + at % own[:, 3] * one
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(take, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(materialize(cut_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
