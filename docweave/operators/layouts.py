"""Frames, assignments of groups to slots, and scores of layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Assignments that are looked at for one request, in the order of their cuts. Fixed value of the model.
MOST_ASSIGNMENTS = 256


def divided(start: Column, extent: Column, gap: Column, weights: Column) -> Column:
    """start and extent of parts of a line by weight, with gaps between; the last part takes the rest."""
    start, extent, gap = (c.cast("long") for c in (start, extent, gap))
    div = lambda a, b: F.call_function("div", a, b)
    n = F.size(weights)
    free = extent - gap * F.greatest(n - 1, F.lit(0))
    total = F.greatest(F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w), F.lit(1))
    part = "array<struct<start:bigint,extent:bigint>>"

    def step(acc: Column, w: Column) -> Column:
        last = F.size(acc["parts"]) == n - 1
        own = F.when(last, start + extent - acc["at"]).otherwise(div(free * w, total))
        return F.struct((acc["at"] + own + gap).alias("at"), F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("start"), own.alias("extent")))).alias("parts"))

    return F.aggregate(weights, F.struct(start.alias("at"), F.array().cast(part).alias("parts")), step, lambda acc: acc["parts"])


def assignments(requests: DataFrame, key: str) -> DataFrame:
    """key, number (from 1) and ``cuts`` of the ways to deal ``groups`` in order to ``slots`` (or to as many as there are groups), in the order of cuts, at most 256 for each request."""
    asked = requests.filter("groups > 0 and slots > 0").select(key, "groups", F.least("slots", "groups").alias("used"), F.array().cast("array<int>").alias("cuts"))
    most = asked.agg(F.max("used")).first()[0] or 0
    done = asked.filter("used = 1")
    rest = asked.filter("used > 1")
    for placed in range(1, most):
        first = F.coalesce(F.get("cuts", F.lit(placed - 2)), F.lit(0)) + 1 if placed > 1 else F.lit(1)
        last = (F.col("groups") - (F.col("used") - placed)).cast("int")
        rest = rest.withColumn("cut", F.explode(F.sequence(first.cast("int"), last))).withColumn("cuts", F.concat("cuts", F.array("cut"))).drop("cut")
        # no more than the first 256 of each request go on: later ones can only follow them
        w = Window.partitionBy(key).orderBy("cuts")
        rest = rest.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MOST_ASSIGNMENTS).drop("n")
        done, rest = done.unionByName(rest.filter(F.col("used") == placed + 1)), rest.filter(F.col("used") > placed + 1)
    return done.select(key, F.row_number().over(Window.partitionBy(key).orderBy("cuts")).alias("number"), "cuts")


def scores(slots: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the balance of candidates from their slots (y, height, cursor, reduction; in the order of ``slot``): readability, imbalance, whitespace and order_balance."""
    used = F.greatest(F.least(F.col("cursor") - F.col("y"), F.col("height")), F.lit(0)).cast("long")
    rise = F.greatest(used - F.lag(used).over(Window.partitionBy(*keys).orderBy("slot")), F.lit(0))
    rows = slots.withColumn("used", used).withColumn("rise", F.coalesce(rise, F.lit(0)))
    div = lambda a, b: F.call_function("div", a, b)
    one = F.lit(1).cast("long")
    sums = rows.groupBy(*keys).agg(F.max("used").alias("most"), F.min("used").alias("least"), F.sum("used").alias("all_used"), F.sum(F.greatest(F.col("height"), F.lit(0))).cast("long").alias("room"), F.max("reduction").cast("long").alias("reduction"), F.sum("rise").alias("order_balance"))
    room = F.greatest("room", one)
    sums = sums.withColumn("share", div((room - F.least("all_used", room)) * 1000, room))
    imbalance = div((F.col("most") - F.col("least")) * 1000, F.greatest("most", one))
    return sums.select(*keys, "reduction", imbalance.alias("imbalance"), (F.col("share") * F.col("share")).alias("whitespace"), "order_balance")
