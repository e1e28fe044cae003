"""Ordered computations: islands, coverage, shares, relations of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """``df`` with ``island``: the number of the run of equal neighbours within each group, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__changed", changed).withColumn("island", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")


def coverage(df: DataFrame, keys: list[str], order: list, start: str, end: str) -> DataFrame:
    """``df`` with ``verdict`` of each slice in order: ok, gap (starts past all before) or duplicate (starts inside them, or is empty)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.max(end).over(w), F.lit(0))
    verdict = F.when((F.col(start) < cursor) | (F.col(end) <= F.col(start)), "duplicate").when(F.col(start) > cursor, "gap").otherwise("ok")
    return df.withColumn("cursor", cursor).withColumn("verdict", verdict)


def coverage_report(slices: DataFrame, extents: DataFrame, keys: list[str], order: list, start: str, end: str, extent: str) -> DataFrame:
    """keys, losses and duplications of each extent (keys, extent) that slices in order should cover: gaps and ends that are missed or passed, and slices that overlap or are empty. Only faulty ones come out."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = slices.withColumn("__cursor", F.coalesce(F.max(end).over(w), F.lit(0)))
    gaps, twice = F.col(start) > F.col("__cursor"), (F.col(start) < F.col("__cursor")) | (F.col(end) <= F.col(start))
    per = rows.groupBy(*keys).agg(F.count_if(gaps).alias("gaps"), F.count_if(twice).alias("duplications"), F.max(end).alias("__end"))
    out = extents.join(per, keys, "left")
    short = F.when(F.coalesce("__end", F.lit(0)) != F.col(extent), 1).otherwise(0)
    out = out.select(*keys, (F.coalesce("gaps", F.lit(0)) + short).alias("losses"), F.coalesce("duplications", F.lit(0)).alias("duplications"))
    return out.filter("losses > 0 or duplications > 0")


def decreasing(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value is below the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous") > F.col(value))


def neighbours(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<c>`` of the following row of its group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def shares(df: DataFrame, keys: list[str], order: list, weight: Column, total: int) -> DataFrame:
    """``df`` with ``share``: whole parts of ``total`` by weight, at least 1; the last member takes the rest (at least 1)."""
    group = Window.partitionBy(*keys)
    w = group.orderBy(*order)
    part = F.greatest(F.lit(1), F.floor(F.lit(total) * weight / F.sum(weight).over(group))).cast("long")
    df = df.withColumn("__part", part).withColumn("__last", F.row_number().over(w) == F.count(F.lit(1)).over(group))
    used = F.coalesce(F.sum("__part").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("share", F.when(F.col("__last"), F.greatest(F.lit(1), F.lit(total) - used)).otherwise(F.col("__part")).cast("long")).drop("__part", "__last")


def running_offsets(df: DataFrame, keys: list[str], order: list, length: str) -> DataFrame:
    """``df`` with start and end of each piece laid one after the other."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - F.col(length))


def auto_numbers(df: DataFrame, keys: list[str], order: list, level: str, numbered: str, start: str, levels: int = 9) -> DataFrame:
    """``df`` with ``number`` of numbered paragraphs: each level counts on until a paragraph of a lower level comes; unnumbered ones change nothing."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.lit(0)
    for n in range(levels):
        lower = F.sum(F.when(F.col(numbered) & (F.col(level) < n), 1).otherwise(0)).over(w)
        breaks = F.when(F.col(level) == n, lower).otherwise(breaks)
    df = df.withColumn("__island", F.coalesce(breaks, F.lit(0)))
    own = Window.partitionBy(*keys, level, "__island", numbered).orderBy(*order)
    first = F.first(F.greatest(F.col(start), F.lit(1))).over(own)
    return df.withColumn("number", F.when(F.col(numbered), first + F.row_number().over(own) - 1)).drop("__island")


def within_budget(df: DataFrame, keys: list[str], recent_first: list, weight: str, budget: int) -> DataFrame:
    """The most recent rows whose weights together stay within the budget; rows heavier than the budget are refused."""
    w = Window.partitionBy(*keys).orderBy(*recent_first).rowsBetween(Window.unboundedPreceding, 0)
    return df.filter(F.col(weight) <= budget).withColumn("held", F.sum(weight).over(w)).filter(F.col("held") <= budget)


#: Slices of a group's range of values in which ranks are looked for.
SLICES = 1_000


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, ``n`` and for each name the least value that so large a share of the group's values do not exceed (null values do not count).

    Values are counted in slices of the group's range first; only the slice that a rank
    falls into is put in order, so no task sorts or holds a whole group.
    """
    rows = df.filter(F.col(value).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.count(F.lit(1)).alias("n"))
    place = (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low")) * SLICES
    sliced = rows.join(ends, keys).withColumn("__slice", F.when(F.col("__high") > F.col("__low"), F.least(F.floor(place), F.lit(SLICES - 1))).otherwise(0))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__in"), F.first("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)  # one row for each slice
    upto = counts.withColumn("__upto", F.sum("__in").over(w))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("n") * share)).alias("rank")) for name, share in shares.items())))
    met = upto.withColumn("__asked", asked).filter((F.col("__asked.rank") <= F.col("__upto")) & (F.col("__asked.rank") > F.col("__upto") - F.col("__in")))
    met = met.select(*keys, "__slice", F.col("__asked.name").alias("__name"), (F.col("__asked.rank") - (F.col("__upto") - F.col("__in"))).alias("__rank"))
    values = sliced.select(*keys, "__slice", value).join(met, [*keys, "__slice"]).groupBy(*keys, "__name", "__rank", value).agg(F.count(F.lit(1)).alias("__in"))
    inside = Window.partitionBy(*keys, "__name").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = values.withColumn("__upto", F.sum("__in").over(inside)).filter(F.col("__upto") >= F.col("__rank")).groupBy(*keys).agg(*(F.min(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in shares))
    return ends.select(*keys, "n").join(found, keys)
