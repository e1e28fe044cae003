"""Checks on untrusted parts: each gives coded verdicts, none fails the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fragments of names and content types that mark active content. Fixed values.
MACRO_MARKS = ("vbaproject", "macroenabled", "activex", "oleobject")


def active_content(name: Column, content_type: Column) -> Column:
    """Whether a part's name or content type marks a macro or another program."""
    both = F.lower(F.concat_ws(" ", name, content_type))
    return reduce(lambda a, b: a | b, (F.contains(both, F.lit(mark)) for mark in MACRO_MARKS))


def image_verdict(extension: Column, content_type: Column, size: Column) -> Column:
    """``ok``, or the first rule that an image breaks."""
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "EMPTY")
        .when(~F.regexp_like(extension, F.lit("^[A-Za-z0-9]{1,16}$")), "EXTENSION")
        .when(~content_type.startswith("image/") | F.regexp_like(content_type, F.lit("[\\s\"']")), "CONTENT_TYPE")
        .otherwise("ok")
    )


def chart_verdict(values: Column, categories: Column) -> Column:
    """Charts need categories, as many values, and finite ones."""
    return (
        F.when(F.size(categories) == 0, "EMPTY")
        .when(F.size(values) != F.size(categories), "LENGTH")
        .when(F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "NOT_FINITE")
        .otherwise("ok")
    )


def contained(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether rectangle a (x, y, w, h) lies in b, edges included; not where a far edge is beyond 64 bits."""
    ax, ay, aw, ah = (c.cast("long") for c in a)
    bx, by, bw, bh = (c.cast("long") for c in b)
    return F.coalesce((ax >= bx) & (ay >= by) & (F.try_add(ax, aw) <= F.try_add(bx, bw)) & (F.try_add(ay, ah) <= F.try_add(by, bh)), F.lit(False))


def required_counts(observed: DataFrame, expected: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Expectations (keys, count) with the number observed, where they differ; nothing observed counts as 0."""
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
    return expected.join(seen, keys, "left").withColumn("observed", F.coalesce("observed", F.lit(0))).filter(F.col("observed") != F.col(count))


def budget_verdict(value: Column, ceiling: Column | None = None, floor: Column | None = None) -> Column:
    """Whether a figure is within its limits."""
    out = F.lit("ok")
    if floor is not None:
        out = F.when(value < floor, "below").otherwise(out)
    if ceiling is not None:
        out = F.when(value > ceiling, "above").otherwise(out)
    return out


def quarantine(df: DataFrame, verdict: Column, good: str = "ok") -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that do not with their verdict as ``code``."""
    marked = df.withColumn("code", verdict)
    return marked.filter(F.col("code") == good).drop("code"), marked.filter(F.col("code") != good)


def active_problems(parts: DataFrame, keys: list[str], name: str, content_type: str) -> DataFrame:
    """keys, the names of a package's active parts in order, and the first of them. A package's active parts meet in one row."""
    found = parts.filter(active_content(F.col(name), F.col(content_type)))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias("problems")).withColumn("first", F.element_at("problems", 1))


def normalized_growth(small: Column, large: Column, small_size: Column, large_size: Column) -> Column:
    """How much faster than its input a figure grows: 1 is in proportion; null where nothing was measured."""
    return F.when((small > 0) & (small_size > 0), (large / small) / (large_size / small_size))
