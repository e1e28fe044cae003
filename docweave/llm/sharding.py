"""Sharding by extendible hashing, with DataFrame functions alone.

A row's hash has 60 bits: 30 of its key and 30 of its id and text, so rows of one hot
key part ways once the key's bits are used up. Shards are prefixes of that hash. The
directory is worked out on sizes alone: rows are summed into cells of some bits, cells
into their prefixes, and the first prefix along a cell's path that fits the byte limit
is its shard, so only oversized buckets split. Cells that do not fit even alone are
summed again with more bits, those rows only, until all do.

Rows meet the directory by their cell, in a shuffled join, for the directory grows with
the rows; a cell is smaller than a shard, so no key's share of the rows lands in one
task.

Defined results: null and empty texts have no bytes and stay in the shard of their
hash; a null key or id hashes like an empty string; a shard of one row (or of equal rows) that
is larger than the limit cannot split and is marked ``oversized``; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, spread_join

BITS = 60
#: Bits by which a directory grows past the estimate, and in each further round.
SPARE, MORE = 4, 8
#: Paths through one node that meet in one place, about.
PATHS = 256
#: Bytes of text a shard may hold in the query.
LIMIT = 1 << 20


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and h, the 60-bit hash, of every row."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    bits = lambda c: F.shiftright(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), 2)
    own = bits(F.concat(name(doc_id), F.lit("\n"), name(text)))
    return docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(name(text)).cast("long").alias("n_bytes"), F.shiftleft(bits(name(key)), 30).bitwiseOR(own).alias("h"))


def directory(rows: DataFrame, limit: int) -> list[DataFrame]:
    """The directory as tables (cell_bits, cell, depth, shard, shard_bytes, oversized), one for each round."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(BITS, max(1, math.ceil(math.log2(max(2.0, total / limit))) + SPARE))
    low, rounds, frontier = 0, [], rows
    while True:
        cells = frontier.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), (F.min("h") == F.max("h")).alias("alone"))
        cells = materialize(cells, "cells")
        paths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
        paths = paths.select("cell", "bytes", F.struct("depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")).alias("node"))
        nodes = paths.groupBy("node").agg(F.sum("bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
        # all paths begin at the same few nodes, so these are dealt to shares
        met = spread_join(paths.select("cell", "node"), nodes, "node", ["cell"], PATHS, "shuffle_hash", many_keys=True)
        fits = met.groupBy("cell").agg(F.min(F.struct("node.depth", "node.prefix", "shard_bytes")).alias("leaf"))
        last = F.lit(bits == BITS)
        found = cells.join(fits.hint("shuffle_hash"), "cell", "left").select(
            F.lit(bits).alias("cell_bits"),
            "cell",
            F.coalesce("leaf.depth", F.lit(bits)).alias("depth"),
            F.coalesce("leaf.prefix", "cell").alias("shard"),
            F.coalesce("leaf.shard_bytes", "bytes").alias("shard_bytes"),
            F.col("leaf").isNull().alias("oversized"),
            (F.col("leaf").isNull() & ~F.col("alone") & ~last).alias("split"),
        )
        found = materialize(found, "directory")
        rounds.append(found.filter("not split").drop("split"))
        open_cells = found.filter("split").select("cell")
        if open_cells.isEmpty():
            return rounds
        frontier = materialize(frontier.withColumn("cell", F.shiftright("h", BITS - bits)).join(open_cells.hint("shuffle_hash"), "cell", "left_semi").drop("cell"), "frontier")
        low, bits = bits + 1, min(BITS, bits + MORE)


def shard(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, depth (bits of the shard's prefix), shard (the prefix), shard_bytes and oversized of every row."""
    rows = materialize(hashed(docs, key), "hashed")
    out = None
    for found in directory(rows, limit):
        bits = found.select("cell_bits").limit(1).collect()
        if bits:
            part = rows.withColumn("cell", F.shiftright("h", BITS - bits[0].cell_bits)).join(found.hint("shuffle_hash"), "cell")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(False).alias("oversized")).filter("false")
    return out.select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "oversized")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in shards of at most a MiB of text."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = f"""
WITH rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    (((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT >> 2) << 30)
      | (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 8))::BIGINT >> 2)) AS h
  FROM documents),
paths AS (SELECT doc_id, n_bytes, d.depth AS depth, h >> ({BITS} - d.depth) AS shard FROM rows, (SELECT unnest(range(0, 25)) AS depth) d),
nodes AS (SELECT depth, shard, sum(n_bytes) AS shard_bytes FROM paths GROUP BY depth, shard),
fits AS (SELECT p.doc_id, min(p.depth) AS depth FROM paths p JOIN nodes n ON p.depth = n.depth AND p.shard = n.shard WHERE n.shard_bytes <= {LIMIT} GROUP BY p.doc_id)
SELECT p.doc_id, CAST(p.n_bytes AS BIGINT) AS n_bytes, CAST(p.depth AS INTEGER) AS depth, CAST(p.shard AS BIGINT) AS shard, CAST(n.shard_bytes AS BIGINT) AS shard_bytes, false AS oversized
FROM fits f JOIN paths p ON p.doc_id = f.doc_id AND p.depth = f.depth JOIN nodes n ON n.depth = p.depth AND n.shard = p.shard
"""
