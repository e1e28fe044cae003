"""Revisions: differences, overlays, fingerprints, plan reuse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and change (added, removed, changed) of rows whose presence or values differ."""
    a = old.select(*keys, F.struct(*columns).alias("__old"))
    b = new.select(*keys, F.struct(*columns).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).filter("change is not null")


def overlay(base: DataFrame, overrides: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """The base without removed and overridden rows, and the overrides; ``overridden`` tells them apart."""
    kept = base.join(overrides.select(*keys).unionByName(removed.select(*keys)).distinct(), keys, "left_anti")
    return kept.withColumn("overridden", F.lit(False)).unionByName(overrides.withColumn("overridden", F.lit(True)))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that exactly one side has: one shuffle for both, as an aggregate over their union."""
    side = lambda df, n: df.select("*", F.lit(n).alias("__side"))
    both = side(a, 1).unionByName(side(b, 2)).groupBy(*a.columns).agg(F.min("__side").alias("__low"), F.max("__side").alias("__high"))
    return both.filter(F.col("__low") == F.col("__high")).drop("__low", "__high")


def length_prefixed(*values: Column) -> Column:
    """A text in which each value stands behind its length, so that no two lists of values read the same."""
    text = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.concat(*(piece for t in text for piece in (F.char_length(t).cast("string"), F.lit(":"), t)))


def fingerprint(df: DataFrame, keys: list[str], order: list[str], item: Column) -> DataFrame:
    """keys and the SHA-256 of the group's items in order. Items of a group meet in one row, so groups must be small (a document's parts)."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, item.alias("item"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(pairs, lambda p: p["item"]), ""), 256).alias("fingerprint"))


def stable_id(domain: str, *values: Column) -> Column:
    """32 hexadecimal digits: a domain-separated, length-prefixed SHA-256."""
    return F.substring(F.sha2(F.concat(F.lit(domain + "\n"), length_prefixed(*values)), 256), 1, 32)


def first_reason(checks: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first check that fails, in order."""
    return reduce(lambda out, check: F.when(~check[1], check[0]).otherwise(out), reversed(checks), F.lit(otherwise))
