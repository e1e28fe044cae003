"""Helpers that the operators of this package have in common."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named, a local master (tests, a laptop) gets a folder of its own
    once; any other raises, for its executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path below this application's part of the shared folder."""
    return f"{shared_dir(spark)}/docweave-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. Results that were not written elsewhere can't be read any more."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/docweave-{spark.sparkContext.applicationId}")
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as it takes to clash with no column (Spark's names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read, not a recomputation,
    and two consumers of one table do not compute it twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that meet in one place, about, and the finest split of a key.
SHARE_ROWS, CELLS = 20_000, 4096


def spread_join(large: DataFrame, small: DataFrame, key: str, by: list[str], share_rows: int = SHARE_ROWS, hint: str = "merge", many_keys: bool = False) -> DataFrame:
    """``large`` joined to ``small`` on ``key``, where one key may hold any part of ``large``.

    Keys of more than ``share_rows`` rows are dealt to shares by a hash of ``by``, and
    their rows of ``small`` go to each share once. Counts go from cells (of that hash)
    up to the key and back to its cells, so no step meets all rows of a key. ``large``
    is read twice, so give a stored table; its column names must begin with a letter.
    ``hint`` keeps the join shuffled, for ``small`` may grow, too; with ``many_keys``
    to be dealt so are the steps before it.
    """
    shuffled = lambda df: df.hint(hint) if many_keys else df
    celled = large.withColumn("_cell", F.pmod(F.xxhash64(*by), F.lit(CELLS)).cast("int"))
    counts = celled.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.groupBy(key).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > share_rows)
    shares = counts.select(key, "_cell").join(shuffled(hot), key).select(key, "_cell", F.pmod("_cell", F.ceil(F.col("_n") / share_rows).cast("int")).alias("_share"))
    dealt = celled.join(shuffled(shares), [key, "_cell"], "left").withColumn("_share", F.coalesce("_share", F.lit(0))).drop("_cell")
    copies = small.join(shuffled(shares.select(key, "_share").distinct()), key, "left").withColumn("_share", F.coalesce("_share", F.lit(0)))
    return dealt.join(copies.hint(hint), [key, "_share"]).drop("_share")


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    """Number of partitions to deal keyed work to."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def buckets_for(rows: int, per_bucket: int) -> int:
    """How many buckets keep each near ``per_bucket`` rows."""
    return max(1, math.ceil(rows / per_bucket))
