"""Token ids in ORC: run-length encoded stripes with row indexes and Bloom filters.

``write_token_orc`` range-partitions documents by id, encodes every whole text
and writes ORC files in ascending ``doc_id`` order. Inside a stripe ORC keeps
integers run-length encoded; its row index holds minimum and maximum of every
stride and a Bloom filter on ``doc_id``, so a reader skips files, stripes and
strides by metadata (``lookup_tokens``) and any number of tasks read stripes of
one file at a time.

Defined results: a null or empty text is the end token alone; repeated rows and rows
that share an id are written as often as they come, one after the other; rows with a null ``doc_id`` come first and keep
their place; an empty table gives an empty directory of ORC files. Columns other
than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, scratch_path, shuffle_width
from .tokens import WordIds, tokenizer_path, worker_local
from .words import text_slices

#: Id that closes each document.
END_ID = 1


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ``tokens`` (array of int, closed by ``end_id``) of every text."""

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words = worker_local(("word ids", tokenizer), lambda: WordIds(tokenizer))
        for batch, texts in text_slices(batches):
            ids, first = words.encode(texts, end_id)
            tokens = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens], names=["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "doc_id long, tokens array<int>")


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, files: int | None = None, stripe_mb: int = 16, row_stride: int = 10_000) -> None:
    """Write ``docs`` as token ids to ORC files at ``path``, in ascending doc_id order."""
    files = files or shuffle_width(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    (
        encode_documents(ordered, tokenizer, end_id)
        .write.option("compression", "zlib")
        .option("orc.stripe.size", stripe_mb << 20)
        .option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and tokens, as the files have them; files and stripes are read in parallel."""
    return spark.read.schema("doc_id long, tokens array<int>").orc(path)


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token ids of a few documents; statistics and Bloom filters prune the rest."""
    return read_token_orc(spark, path).filter(F.col("doc_id").isin(list(doc_ids)))


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files.

    Counts and checksums are taken in one pass over the stripes. ``start`` adds
    the ids of the files before to a running sum inside the file, in the order of its
    rows: by the part of the file that a task reads, and by place in that part. The
    files hold ranges of doc_id, so only one row per file meets in one place.
    """

    def digest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tokens = batch.column("tokens")
            ends = np.asarray(tokens.offsets)
            ids = np.asarray(tokens.values).astype("<i4", copy=False)
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "block", "at", "doc_id")), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, type=pa.int64())],
                names=["file", "block", "at", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = read_token_orc(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "doc_id", "tokens")
    digests = materialize(rows.mapInArrow(digest, "file string, block long, at long, doc_id long, n_tokens long, ids_crc32 long"), "token-digests")
    per_file = digests.groupBy("file").agg(F.min("doc_id").alias("first_id"), F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_file.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        digests.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "file")
        .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: write ``documents`` as ORC, read the files back."""
    path = scratch_path(spark, "token-orc")
    write_token_orc(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("word_bpe_49k.json"))
    return token_positions(spark, path)
