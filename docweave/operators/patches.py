"""Patches of texts: splices at original places, checked for overlap, applied as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins


def overlapping_patches(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Patches that begin before the one before them ends; touching is legal."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return patches.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("before") > F.col("start"))


def spliced(text: Column, patches: Column) -> Column:
    """A text with patches (array of start, end, value; code points, in order, apart) put in. Each stretch between two is cut once."""
    ends = F.concat(F.array(F.lit(0)), F.transform(patches, lambda p: p["end"].cast("int")))
    parts = F.zip_with(patches, F.slice(ends, F.lit(1), F.size(patches)), lambda p, was: F.concat(F.substring(text, was + 1, p["start"].cast("int") - was), p["value"]))
    return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text)))


def apply_patches(texts: DataFrame, patches: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``texts`` with their patches (keys, start, end, value) applied; a text's patches meet in its row, so they must be few beside its length."""
    lists = patches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("__patches"))
    joined = texts.join(lists, keys, "left")
    return joined.withColumn(text, F.when(F.col("__patches").isNull(), F.col(text)).otherwise(spliced(F.col(text), F.col("__patches")))).drop("__patches")


def innermost(intervals: DataFrame, places: DataFrame, keys: list[str], cell: int = 1) -> DataFrame:
    """For each place (keys, at) the latest-starting interval [start, end) around it, then the one with the greatest id.

    Equal intervals are one, cut into blocks of cells; each block keeps its best interval
    and a place looks its blocks up, one of each size, so that no pair of an interval and
    a place is formed. Cells that an interval holds in part keep its ends, which are then
    compared.
    """
    exact = joins.integral((intervals, ["start", "end"]), (places, ["at"]))
    number = lambda c: (F.col(c).cast("long") if exact else F.col(c)).alias(c)
    solid = intervals.select(*keys, number("start"), number("end"), "id").filter(joins.finite(F.col("start"), F.col("end")) & (F.col("start") < F.col("end")))
    span = (F.col("start"), F.col("end"), cell, exact, False)
    cut = solid.groupBy(*keys, "start", "end").agg(F.max("id").alias("id")).withColumn("__b", F.explode(joins.blocks(*span)))
    rest = F.when(~F.col("__b.whole"), F.struct("start", "end")).alias("__rest")
    best = joins.best_by(cut.select(*keys, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"), rest, "start", "id"), [*keys, "__level", "__block", "__rest"], "start", "id")
    reach = solid.agg(F.max(joins.top_level(*span)).alias("__top"))
    asked = places.select(*keys, number("at")).filter(joins.finite(F.col("at"))).distinct().crossJoin(F.broadcast(reach))
    asked = asked.withColumn("__level", F.explode(F.sequence(F.lit(0), "__top"))).withColumn("__block", joins.block_of(joins.cell_of(F.col("at"), cell, exact), F.col("__level")))
    inside = (F.col("__rest.start") <= F.col("at")) & (F.col("at") < F.col("__rest.end"))
    around = asked.join(best, [*keys, "__level", "__block"]).filter(F.col("__rest").isNull() | inside)
    return around.groupBy(*keys, "at").agg(F.max("top").alias("top")).select(*keys, "at", F.col("top.id").alias("id"))
