"""Lookups of the package model as joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def content_types(parts: DataFrame, overrides: DataFrame, defaults: DataFrame) -> DataFrame:
    """``parts`` (name) with content_type and source: an override of the name, else the default of its last extension.

    Of repeated keys the last one (by ``ord``) wins. Both lookups are equi joins.
    """
    last = lambda df, key: df.groupBy(key).agg(F.max_by("content_type", "ord").alias("content_type"))
    over = last(overrides.withColumn("name", F.regexp_replace("name", "^/", "")), "name").withColumnRenamed("content_type", "own")
    base = last(defaults.withColumn("extension", F.lower("extension")), "extension").withColumnRenamed("content_type", "base")
    named = parts.withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^./]*)$", 1)))
    out = named.join(over, "name", "left").join(base, "extension", "left")
    source = F.when(F.col("own").isNotNull(), "Override").when(F.col("base").isNotNull(), "Default").otherwise("Missing")
    return out.withColumn("content_type", F.coalesce("own", "base")).withColumn("source", source).drop("own", "base")


def resolve(references: DataFrame, targets: DataFrame, on: Column, external: Column, found: Column) -> DataFrame:
    """``references`` joined to what they name, with kind External, Internal or Missing."""
    joined = references.join(targets, on & ~external, "left")
    return joined.withColumn("kind", F.when(external, "External").when(found.isNotNull(), "Internal").otherwise("Missing"))


def select_targets(declared: DataFrame, candidates: DataFrame, key: str, id_match: tuple[str, str], name_match: tuple[str, str]) -> DataFrame:
    """For each declaration how many candidates match by id and name (an absent selector matches all), and Missing, Bound or Ambiguous.

    Declarations that give an id and those that give a name alone become two equi
    joins, so no pair is formed that a given selector rules out.
    """
    by_id, own_id = id_match
    by_name, own_name = name_match
    with_id = declared.filter(F.col(by_id).isNotNull()).join(candidates, (F.col(by_id) == F.col(own_id)) & (F.col(by_name).isNull() | (F.col(by_name) == F.col(own_name))), "left")
    name_only = declared.filter(F.col(by_id).isNull()).join(candidates, F.col(by_name) == F.col(own_name), "left")
    n = F.count(F.col(own_id))
    counted = with_id.unionByName(name_only).groupBy(key).agg(n.alias("n_matches"), F.min(own_id).alias("first_match"))
    return counted.withColumn("outcome", F.when(F.col("n_matches") == 0, "MissingTarget").when(F.col("n_matches") == 1, "Bound").otherwise("AmbiguousTarget"))


def inherit(df: DataFrame, layers: list[tuple[DataFrame, list[str]]], fields: list[str]) -> DataFrame:
    """Fields of ``df``, each from the nearest layer that has it; layers join on their keys."""
    for i, (layer, keys) in enumerate(layers):
        df = df.join(layer.select(*keys, *(F.col(f).alias(f"__{i}_{f}") for f in fields)), keys, "left")
    chosen = {f: F.coalesce(f, *(F.col(f"__{i}_{f}") for i in range(len(layers)))) for f in fields}
    return df.withColumns(chosen).drop(*(f"__{i}_{f}" for i in range(len(layers)) for f in fields))


def overlapping_rectangles(df: DataFrame, keys: list[str], rect: tuple[str, str, str, str], id_column: str, cell: int = 64) -> DataFrame:
    """Pairs of rectangles of a group that overlap (touching edges do not), smaller id first. Rectangles without area are left out.

    Rectangles are listed in the grid cells they touch, so only neighbours meet; a pair
    comes from the cell that holds the upper left corner of what both share.
    """
    x, y, w, h = rect
    solid = df.filter((F.col(w) > 0) & (F.col(h) > 0)).select(*keys, F.col(id_column).alias("id"), *(F.col(c).alias(n) for c, n in zip(rect, "xywh")))
    span = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size) - 1) / cell))
    listed = solid.withColumn("__cx", F.explode(span("x", "w"))).withColumn("__cy", F.explode(span("y", "h")))
    other = listed.select(*keys, "__cx", "__cy", *(F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "w", "h")))
    met = listed.join(other, [*keys, "__cx", "__cy"]).filter(F.col("id") < F.col("b_id"))
    left, top = F.greatest("x", "b_x"), F.greatest("y", "b_y")
    shared = (left < F.least(F.col("x") + F.col("w"), F.col("b_x") + F.col("b_w"))) & (top < F.least(F.col("y") + F.col("h"), F.col("b_y") + F.col("b_h")))
    first = (F.col("__cx") == F.floor(left / cell)) & (F.col("__cy") == F.floor(top / cell))
    return met.filter(shared & first).select(*keys, F.col("id").alias("id_a"), F.col("b_id").alias("id_b"))


def spans_meeting(tokens: DataFrame, runs: DataFrame, keys: list[str], cell: int = 1000) -> DataFrame:
    """Token intervals [t_start, t_end) cut at the runs [r_start, r_end) they reach into; empty meetings are dropped.

    Both are listed in the cells they touch, so a long text's tokens do not all meet all
    of its runs; a pair comes from its first common cell alone.
    """
    listed = lambda df, a, b: df.filter(F.col(b) > F.col(a)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))))
    start, end = F.greatest("t_start", "r_start"), F.least("t_end", "r_end")
    met = listed(tokens, "t_start", "t_end").join(listed(runs, "r_start", "r_end"), [*keys, "__cell"]).withColumn("start", start).withColumn("end", end)
    return met.filter((F.col("start") < F.col("end")) & (F.col("__cell") == F.floor(F.col("start") / cell))).drop("__cell")


def cell_of(at: Column, cell: int, integral: bool) -> Column:
    """The grid cell [cell * k, cell * (k + 1)) that holds a place, as k."""
    return F.call_function("div", at - F.pmod(at, F.lit(cell)), F.lit(cell)) if integral else F.floor(at / cell).cast("long")


def block_of(k: Column, level: Column) -> Column:
    """The block of 2 ** level cells that holds cell k."""
    return F.call_function("shiftright", k, level)


def whole_cells(low: Column, high: Column, cell: int, integral: bool, closed: bool) -> tuple[Column, Column]:
    """First cell that lies in [low, high) (with ``high`` if ``closed``) as a whole, and the one after the last."""
    return -cell_of(-low, cell, integral), cell_of(high + 1 if closed and integral else high, cell, integral)


def top_level(low: Column, high: Column, cell: int, integral: bool, closed: bool) -> Column:
    """No block of ``blocks`` has a higher level: the number of whole cells, in binary digits, less one."""
    first, stop = whole_cells(low, high, cell, integral, closed)
    return F.char_length(F.bin(F.greatest(stop - first, F.lit(1)))) - 1


def blocks(low: Column, high: Column, cell: int, integral: bool, closed: bool) -> Column:
    """An interval cut into aligned blocks of 1, 2, 4, ... cells, at most two of each size: array of level, block, whole.

    Blocks do not overlap. Cells at the ends that the interval holds in part are listed
    with ``whole`` false; whole numbers on cells of 1 have none.
    """
    first, stop = whole_cells(low, high, cell, integral, closed)

    def cut(level: Column) -> Column:
        a, b = -block_of(-first, level), block_of(stop, level) - 1
        # those whose next larger block reaches out of the interval
        ends = F.filter(F.array_distinct(F.array(a, b)), lambda k: (a <= b) & (((k == a) & (k % 2 != 0)) | ((k == b) & (k % 2 == 0))))
        return F.transform(ends, lambda k: F.struct(level.alias("level"), k.alias("block"), F.lit(True).alias("whole")))

    inner = F.flatten(F.transform(F.sequence(F.lit(0), top_level(low, high, cell, integral, closed)), cut))
    ends = F.array(cell_of(low, cell, integral), cell_of(high, cell, integral) if closed else -cell_of(-high, cell, integral) - 1)
    part = F.filter(F.array_distinct(ends), lambda k: (k < first) | (k >= stop))
    return F.concat(inner, F.transform(part, lambda k: F.struct(F.lit(0).alias("level"), k.alias("block"), F.lit(False).alias("whole"))))


def integral(*sides: tuple[DataFrame, list[str]]) -> bool:
    return all(isinstance(df.schema[c].dataType, IntegralType) for df, names in sides for c in names)


def finite(*columns: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return reduce(and_, (c - c == 0 for c in columns))


def best_by(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """The greatest ``first``, then ``second`` of each group as the struct ``top``. Rows with the same ``first`` fall together in a hash map, before structs, for which Spark sorts."""
    return df.groupBy(*keys, first).agg(F.max(second).alias(second)).groupBy(*keys).agg(F.max(F.struct(first, second)).alias("top"))


def hit(boxes: DataFrame, points: DataFrame, cell: int = 1) -> DataFrame:
    """For each point the box with the highest z (then id) that holds it, edges included.

    Of boxes (x, y, w, h, z, id) at one place the best stands for all, and points at one
    place are asked once. Boxes are cut into blocks of cells, each block keeps its best
    box, and a point looks its blocks up, one of each size: no pair of a box and a point
    is formed. A box of n by m cells has at most 4 log n log m blocks. Cells that it holds
    in part keep the box's sides, which are then compared.
    """
    exact = integral((boxes, ["x", "y", "w", "h"]), (points, ["px", "py"]))
    number = lambda c: F.col(c).cast("long") if exact else F.col(c)
    sides = [number(c).alias(c) for c in "xywh"]
    points = points.select("point_id", number("px").alias("px"), number("py").alias("py"))
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    solid = boxes.select(*sides, "z", "id").filter(finite(F.col("x"), F.col("y"), right, bottom) & (F.col("w") >= 0) & (F.col("h") >= 0))
    spans = {"x": (F.col("x"), right, cell, exact, True), "y": (F.col("y"), bottom, cell, exact, True)}
    cut = best_by(solid, list("xywh"), "z", "id").withColumns({f"__{axis}": blocks(*span) for axis, span in spans.items()})
    # no list is empty; a plain explode would have Spark test that on every box, before the best are found
    cut = cut.withColumn("__x", F.explode_outer("__x")).withColumn("__y", F.explode_outer("__y"))
    at = ["x_level", "x_block", "y_level", "y_block"]
    keyed = cut.select(*(F.col(f"__{k[0]}.{k[2:]}").alias(k) for k in at), F.when(~(F.col("__x.whole") & F.col("__y.whole")), F.struct(*"xywh")).alias("rest"), "top.z", "top.id")
    best = best_by(keyed, [*at, "rest"], "z", "id")
    reach = solid.agg(*(F.max(top_level(*span)).alias(f"{axis}_top") for axis, span in spans.items()))
    asked = points.select("px", "py").filter(finite(F.col("px"), F.col("py"))).distinct().crossJoin(F.broadcast(reach))
    for axis in "xy":
        asked = asked.withColumn(f"{axis}_level", F.explode(F.sequence(F.lit(0), f"{axis}_top")))
        asked = asked.withColumn(f"{axis}_block", block_of(cell_of(F.col(f"p{axis}"), cell, exact), F.col(f"{axis}_level")))
    inside = F.col("px").between(F.col("rest.x"), F.col("rest.x") + F.col("rest.w")) & F.col("py").between(F.col("rest.y"), F.col("rest.y") + F.col("rest.h"))
    held = asked.join(best, at).filter(F.col("rest").isNull() | inside).groupBy("px", "py").agg(F.max("top").alias("top"))
    return points.join(held, ["px", "py"]).groupBy("point_id").agg(F.max("top").alias("top")).select("point_id", "top.id", "top.z")


def first_by(df: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """The first row of each group by ``order`` (numeric or text columns, each with whether it falls): one aggregate with partial sums, no sort of groups. Falling columns must be numbers; nulls come first."""
    rest = [c for c in df.columns if c not in keys]
    rank = [(-F.col(c) if falls else F.col(c)).alias(f"__{i}") for i, (c, falls) in enumerate(order)]
    top = df.groupBy(*keys).agg(F.min(F.struct(*rank, *rest)).alias("__top"))
    return top.select(*keys, *(F.col(f"__top.{c}").alias(c) for c in rest))


def pruned(candidates: DataFrame, start: list[str], end: list[str], order: list[tuple[str, bool]], most: int = 64) -> DataFrame:
    """The best candidate for each start and end, and of those at most ``most`` for each start, the nearest ends first."""
    best = first_by(candidates, [*start, *end], order)
    return best.withColumn("__n", F.row_number().over(Window.partitionBy(*start).orderBy(*end))).filter(F.col("__n") <= most).drop("__n")
