"""Row policies of tables that must fit a page: continue, clip, shrink, fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with ``row_no`` (from 1) and ``n_rows`` of each group; one shuffle on the keys serves both."""
    group = Window.partitionBy(*keys)
    return df.withColumn("row_no", F.row_number().over(group.orderBy(*order))).withColumn("n_rows", F.count(F.lit(1)).over(group))


def continued(df: DataFrame, keys: list[str], order: list, maximum: int) -> DataFrame:
    """All rows in pages of ``maximum``: page (from 0) and pages."""
    _check(maximum)
    return (
        numbered(df, keys, order)
        .withColumn("page", F.floor((F.col("row_no") - 1) / maximum).cast("int"))
        .withColumn("pages", F.ceil(F.col("n_rows") / maximum).cast("int"))
    )


def clipped(df: DataFrame, keys: list[str], order: list, maximum: int) -> DataFrame:
    """The first ``maximum`` rows of each group; Spark limits groups before the shuffle, too."""
    _check(maximum)
    top = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_no", F.row_number().over(top)).filter(F.col("row_no") <= maximum)


def shrunk(df: DataFrame, keys: list[str], height: Column, maximum: int) -> DataFrame:
    """All rows, with heights scaled to maximum/rows where there are more: rounded up, at least 1."""
    _check(maximum)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    scaled = F.greatest(F.lit(1), F.ceil(height * F.least(n, F.lit(maximum)) / n)).cast("long")
    return df.withColumn("n_rows", n).withColumn("height", F.when(n > maximum, scaled).otherwise(height.cast("long")))


def overflowing(df: DataFrame, keys: list[str], maximum: int) -> DataFrame:
    """One diagnostic for each group of more than ``maximum`` rows; partial counts come before the shuffle."""
    _check(maximum)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > maximum).withColumn("code", F.lit("INVALID_TABLE"))


def page_label(page: Column, pages: Column) -> Column:
    """``n/total`` where there is more than one page."""
    return F.when(pages > 1, F.concat((page + 1).cast("string"), F.lit("/"), pages.cast("string")))


def _check(maximum: int) -> None:
    if maximum < 1:
        raise ValueError("INVALID_TABLE: maximum must be at least 1")
