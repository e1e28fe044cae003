"""Queries on patches, enclosing elements, reuse and flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import patches
from ..registry import query, table


@query("SELECT c_custkey, substr(c_name, 1, 2) || '[' || c_nationkey || ']' || substr(c_name, 6, 2) || '<' || substr(c_name, 8) AS c_name FROM customer")
def text_splice(spark: SparkSession, d: str) -> DataFrame:
    """Two patches of each name, given in any order: one replaces, one inserts."""
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    first = customers.select("c_custkey", F.lit(2).alias("start"), F.lit(5).alias("end"), F.concat(F.lit("["), F.col("c_nationkey").cast("string"), F.lit("]")).alias("value"))
    second = customers.select("c_custkey", F.lit(7).alias("start"), F.lit(7).alias("end"), F.lit("<").alias("value"))
    return patches.apply_patches(customers.select("c_custkey", "c_name"), second.unionByName(first), ["c_custkey"], "c_name")


@query("SELECT o_custkey, o_orderkey, st AS start FROM (SELECT *, max(en) OVER (PARTITION BY o_custkey ORDER BY st, en, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT o_custkey, o_orderkey, o_orderkey % 100 AS st, o_orderkey % 100 + 5 AS en FROM orders)) WHERE before > st")
def patch_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Edits of one customer whose places overlap an earlier one's."""
    start = F.col("o_orderkey") % 100
    edits = table(spark, d, "orders").select("o_custkey", "o_orderkey", start.alias("start"), (start + 5).alias("end"))
    w = Window.partitionBy("o_custkey").orderBy("start", "end", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("before", F.max("end").over(w)).filter(F.col("before") > F.col("start")).select("o_custkey", "o_orderkey", "start")


@query(
    """WITH e AS (SELECT p_brand, p_partkey AS id, p_partkey % 60 AS st, p_partkey % 60 + p_size AS en FROM part), p AS (SELECT DISTINCT p_brand, (p_partkey * 7) % 90 AS place FROM part)
    SELECT p_brand, place, id FROM (SELECT p.p_brand, place, id, row_number() OVER (PARTITION BY p.p_brand, place ORDER BY st DESC, id DESC) AS n FROM p JOIN e ON p.p_brand = e.p_brand AND st <= place AND place < en) WHERE n = 1"""
)
def enclosing_element(spark: SparkSession, d: str) -> DataFrame:
    """The innermost element around a place."""
    part = table(spark, d, "part")
    start = F.col("p_partkey") % 60
    elements = part.select("p_brand", F.col("p_partkey").alias("id"), start.alias("start"), (start + F.col("p_size")).alias("end"))
    places = part.select("p_brand", (F.col("p_partkey") * 7 % 90).alias("at")).distinct()
    return patches.innermost(elements, places, ["p_brand"]).withColumnRenamed("at", "place")


@query("SELECT a.o_orderkey, a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AS reused FROM orders a JOIN (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey")
def slide_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Slides whose values are what they were keep their pages."""
    now = table(spark, d, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_orderpriority").alias("now"))
    was = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select("o_orderkey", F.struct("o_orderstatus", F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderpriority")).alias("o_orderpriority")).alias("was"))
    return now.join(was, "o_orderkey").select("o_orderkey", (F.col("now") == F.col("was")).alias("reused"))


@query("SELECT split_part(c_mktsegment || '.' || c_custkey, '.', 1) AS grp, c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids FROM customer GROUP BY 1, 2")
def binding_groups(spark: SparkSession, d: str) -> DataFrame:
    """Bindings of a table by the name before the first stop."""
    ids = table(spark, d, "customer").select(F.split_part(F.concat("c_mktsegment", F.lit("."), F.col("c_custkey").cast("string")), F.lit("."), F.lit(1)).alias("grp"), "c_nationkey", "c_custkey")
    lists = ids.groupBy("grp", "c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("ids"))
    return lists.select("grp", "c_nationkey", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("SELECT user_id, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS misses, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS rate FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS hit FROM events) GROUP BY 1")
def cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The first request of a key misses, later ones hit: counts alone tell."""
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("user_id").agg((F.sum("n") - F.count(F.lit(1))).alias("hits"), F.count(F.lit(1)).alias("misses"))
    return out.withColumn("rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 9))


@query("SELECT l_orderkey, CAST(sum(abs(l_linenumber - prev) * 10 + CASE WHEN l_suppkey <> ps THEN 25 ELSE 0 END) AS BIGINT) AS penalty FROM (SELECT l_orderkey, l_linenumber, l_suppkey, lag(l_linenumber) OVER w AS prev, lag(l_suppkey) OVER w AS ps FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE prev IS NOT NULL GROUP BY 1")
def relation_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Distances and lost sides of neighbours, summed."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    near = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.lag("l_linenumber").over(w).alias("prev"), F.lag("l_suppkey").over(w).alias("ps")).filter("prev is not null")
    cost = F.abs(F.col("l_linenumber") - F.col("prev")) * 10 + F.when(F.col("l_suppkey") != F.col("ps"), 25).otherwise(0)
    return near.groupBy("l_orderkey").agg(F.sum(cost).cast("long").alias("penalty"))


@query("SELECT conv_id, CAST(sum(octet_length(encode(role)) + octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS n FROM conversations GROUP BY 1")
def weights(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of keys and values."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("role") + F.octet_length("text")).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, unit FROM (SELECT conv_id, turn, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS unit FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)) WHERE unit <> ''")
def flow_units(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of a text as ordered units."""
    units = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "unit"))
    return units.filter("unit <> ''").select("conv_id", "turn", (F.col("pos") + 1).alias("pos"), "unit")
