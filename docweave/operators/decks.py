"""Decks: placeholders, element trees, groups of flow units, table pages, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched_placeholders(expected: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """key and ord of the first candidate (idx, kind, ord) of each expected placeholder (key, idx, kind): the same index, or the same kind where either index is 0.

    Each way to match is an equi join; candidates count once for each index or kind first.
    """
    index = candidates.groupBy("idx").agg(F.min("ord").alias("ord"))
    of_kind = candidates.groupBy("kind").agg(F.min("ord").alias("any"), F.min(F.when(F.col("idx") == 0, F.col("ord"))).alias("zero"))
    out = expected.join(index, "idx", "left").join(of_kind, "kind", "left")
    # least() passes over nulls
    return out.select(key, F.least("ord", "zero", F.when(F.col("idx") == 0, F.col("any"))).alias("ord"))


def layered(layers: list[tuple[str, DataFrame]], order: list[str]) -> DataFrame:
    """Rows of all layers, in the order of layers and inside each by ``order``, with ``level`` and ``ordinal`` from 0.

    Numbers come in two steps: counts of the layers, then places inside each one's slices of ``order[0]``.
    """
    rows = None
    for i, (name, df) in enumerate(layers):
        own = df.withColumn("level", F.lit(name)).withColumn("__layer", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("__slice", F.floor(F.col(order[0]) / 10_000))
    before = Window.orderBy("__layer", "__slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each layer and slice
    sums = rows.groupBy("__layer", "__slice").agg(F.count(F.lit(1)).alias("n"))
    bases = sums.select("__layer", "__slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__layer", "__slice").orderBy(*order)) - 1
    return rows.withColumn("__inside", inside).join(bases, ["__layer", "__slice"]).withColumn("ordinal", (F.col("__base") + F.col("__inside")).cast("long")).drop("__layer", "__slice", "__base", "__inside")


def element_parents(tokens: DataFrame, keys: list[str], seq: str = "seq", depth: str = "depth") -> DataFrame:
    """``tokens`` with ``parent``: the last token before each that is one level up. Levels are dealt apart, so any nesting takes one shuffle."""
    openers = tokens.select(*keys, F.col(depth).alias("__level"), F.col(seq).alias("__seq"), F.lit(True).alias("__opens"))
    seekers = tokens.select(*keys, (F.col(depth) - 1).alias("__level"), F.col(seq).alias("__seq"), F.lit(False).alias("__opens"))
    w = Window.partitionBy(*keys, "__level").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__opens"), F.col("__seq")), ignorenulls=True).over(w)
    return openers.unionByName(seekers).withColumn("parent", last).filter(~F.col("__opens")).select(*keys, F.col("__seq").alias(seq), (F.col("__level") + 1).alias(depth), "parent")


def inside_at_depth(ranges: DataFrame, tokens: DataFrame, keys: list[str], cell: int = 64) -> DataFrame:
    """Tokens (seq, depth) one level below the range (start, end, depth, id) they lie in. Ranges are listed in the cells they touch: an equi join."""
    listed = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))).withColumnRenamed("depth", "__depth")
    met = tokens.withColumn("__cell", F.floor(F.col("seq") / cell)).join(listed, [*keys, "__cell"])
    return met.filter((F.col("seq") > F.col("start")) & (F.col("seq") < F.col("end")) & (F.col("depth") == F.col("__depth") + 1)).drop("__cell", "__depth")


def adjacent_pairs(units: DataFrame, keys: list[str], order: str, role: str) -> DataFrame:
    """``units`` with ``related``: whether each belongs with the next (a figure with its caption, a quote with its credit, a section with anything)."""
    following = F.lead(role).over(Window.partitionBy(*keys).orderBy(order))
    pair = ((F.col(role) == "Figure") & (following == "Caption")) | ((F.col(role) == "Quote") & (following == "Credit")) | ((F.col(role) == "Section") & following.isNotNull())
    return units.withColumn("related", F.coalesce(pair, F.lit(False)))


def chained_groups(units: DataFrame, keys: list[str], order: str, related: str = "related") -> DataFrame:
    """``units`` with ``chain``: the place of the first unit of the run that ``related`` ties together."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = ~F.coalesce(F.lag(related).over(w), F.lit(False))
    return units.withColumn("__start", F.when(starts, F.col(order))).withColumn("chain", F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def spanned_groups(units: DataFrame, spans: DataFrame, keys: list[str], order: str, group: str, cell: int = 64) -> DataFrame:
    """``units`` with ``group`` taken from the first unit of the span (start, end of ``order``) that covers each; spans that do not touch one another are independent of their order."""
    listed = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    covered = units.withColumn("__cell", F.floor(F.col(order) / cell)).join(listed, [*keys, "__cell"]).filter(F.col(order).between(F.col("start"), F.col("end")))
    first = units.select(*keys, F.col(order).alias("start"), F.col(group).alias("__first"))
    joined = covered.select(*keys, order, "start").join(first, [*keys, "start"]).groupBy(*keys, order).agg(F.min("__first").alias("__first"))
    return units.join(joined, [*keys, order], "left").withColumn(group, F.coalesce("__first", group)).drop("__first")


def table_pages(tables: DataFrame, rows: DataFrame, keys: list[str], order: list, maximum: int, cell: Column) -> DataFrame:
    """One row for each page of each table: page (from 0), pages, and ``cells``, what ``cell`` gives for its rows in order. A table without rows has one empty page."""
    if maximum < 1:
        raise ValueError("INVALID_TABLE: maximum must be at least 1")
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("__no", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    paged = placed.withColumn("page", F.floor((F.col("__no") - 1) / maximum).cast("int")).withColumn("pages", F.ceil(F.col("__n") / maximum).cast("int"))
    # at most `maximum` rows meet in one page
    gathered = paged.groupBy(*keys, "page", "pages").agg(F.transform(F.array_sort(F.collect_list(F.struct("__no", cell.alias("c")))), lambda x: x["c"]).alias("cells"))
    out = tables.join(gathered, keys, "left")
    kind = dict(gathered.dtypes)["cells"]
    return out.withColumns({"page": F.coalesce("page", F.lit(0)), "pages": F.coalesce("pages", F.lit(1)), "cells": F.coalesce("cells", F.array().cast(kind))})


def merged(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of either side with the merged ``value``, and ``previous`` and ``touched``, from which ``undone`` brings back the base."""
    a = base.select(*keys, F.col(value).alias("previous"), F.lit(True).alias("__had"))
    b = delta.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("touched"))
    out = a.join(b, keys, "full")
    return out.select(*keys, F.when(F.col("touched"), F.col("__new")).otherwise(F.col("previous")).alias(value), "previous", F.coalesce("__had", F.lit(False)).alias("had"), F.coalesce("touched", F.lit(False)).alias("touched"))


def undone(merge: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The base that a merge came from."""
    return merge.filter("had").select(*keys, F.col("previous").alias(value))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides paired by place within their group, and the groups refused because their counts differ (keys, left_rows, right_rows, code)."""
    place = lambda df: df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "left_rows").join(count(right, "right_rows"), keys, "full").select(*keys, F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"))
    refused = sizes.filter("left_rows <> right_rows").withColumn("code", F.lit("COUNT_MISMATCH"))
    a, b = place(left).withColumnRenamed(order, "left_key"), place(right).withColumnRenamed(order, "right_key")
    paired = a.join(refused.select(*keys), keys, "left_anti").join(b, [*keys, "pos"]).select(*keys, "pos", "left_key", "right_key")
    return paired, refused


def relation_loss(media: Column, text: Column, before: Column, caption: Column, proximity: Column, page: tuple[int, int]) -> Column:
    """What it costs that a text stands away from its picture, or on the wrong side; frames are (x, y, width, height)."""
    div = lambda a, b: F.call_function("div", a.cast("long"), F.lit(b).cast("long"))
    middle = lambda f: (f["x"] + div(f["width"], 2), f["y"] + div(f["height"], 2))
    (mx, my), (tx, ty) = middle(media), middle(text)
    dx, dy = F.abs(mx - tx), F.abs(my - ty)
    distance = div((dx + dy) * 1000, max(1, sum(page)))
    is_before = F.when(dx >= dy, tx <= mx).otherwise(ty <= my)
    strength = F.when(caption, 8).when(proximity == "SameParagraph", 4).when(proximity == "AdjacentBlocks", 2).otherwise(1)
    return (distance + F.when(is_before == before, 0).otherwise(250)) * strength
