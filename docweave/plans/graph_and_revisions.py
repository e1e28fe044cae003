"""Queries on graphs, revisions and identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, revisions
from ..registry import query, table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """region -> nation -> customer -> order, as named nodes."""
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    pair = lambda t, a, b: table(spark, d, t).select(a.alias("source"), b.alias("target"))
    out = pair("nation", name("region", "n_regionkey"), name("nation", "n_nationkey"))
    out = out.unionByName(pair("customer", name("nation", "c_nationkey"), name("customer", "c_custkey")))
    return out.unionByName(pair("orders", name("customer", "o_custkey"), name("order", "o_orderkey")))


_EDGES = """edges AS (SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""


@query(
    f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 'region:1' AS node, 0 AS depth UNION ALL SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.node)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node"""
)
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_edges(spark, d), spark.createDataFrame([("region:1",)], "node string"))


@query(
    "SELECT 'order:' || o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"
)
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orders that no large line reaches."""
    name = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    nodes = table(spark, d, "orders").select(name.alias("node"))
    lines = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.lit("root").alias("source"), F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("target"))
    return graph.orphans(nodes, lines, spark.createDataFrame([("root",)], "node string"))


@query(
    f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 'order:' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey < 40 UNION ALL SELECT e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.node)
    SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node"""
)
def invalidation(spark: SparkSession, d: str) -> DataFrame:
    """What depends on the changed orders, over reversed edges."""
    changed = table(spark, d, "orders").filter("o_orderkey < 40").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.affected(_edges(spark, d), changed)


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS source, CAST(p_size AS BIGINT) AS target FROM part), walk AS (SELECT source AS root, target AS node, 1 AS steps FROM e UNION ALL SELECT w.root, e.target, w.steps + 1 FROM walk w JOIN e ON e.source = w.node WHERE w.steps < 60 AND w.node <> w.root)
    SELECT DISTINCT root AS node FROM walk WHERE node = root"""
)
def cycles(spark: SparkSession, d: str) -> DataFrame:
    """Parts that come back to themselves over the part that their size names: every part leads to one other, so the core of the walk is its cycles."""
    edges = table(spark, d, "part").select(F.col("p_partkey").alias("source"), F.col("p_size").cast("long").alias("target"))
    return graph.on_cycles(edges)


_NEW = """n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT o_orderkey + 10000000, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 17 = 0)"""


def _revision(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    edited = old.filter("o_orderkey % 13 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "9-NEW").otherwise(F.col("o_orderpriority")))
    return old, edited.unionByName(old.filter("o_orderkey % 17 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000))


@query(
    f"""WITH {_NEW} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderpriority IS DISTINCT FROM n.o_orderpriority OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus"""
)
def revision_diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = _revision(spark, d)
    return revisions.diff(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


_OVERLAY = """over AS (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0),
  m AS (SELECT o_orderkey, o_orderstatus, false AS overridden FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus, true FROM over)"""


def _overlay(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return revisions.overlay(base, base.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), base.filter("o_orderkey % 11 = 0").select("o_orderkey"), ["o_orderkey"])


@query(f"WITH {_OVERLAY} SELECT * FROM m")
def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    return _overlay(spark, d)


@query(f"WITH {_OVERLAY} SELECT count(*) AS parts, CAST(sum(CASE WHEN overridden THEN 1 ELSE 0 END) AS BIGINT) AS overridden, CAST(sum(CASE WHEN NOT overridden THEN length(o_orderstatus) ELSE 0 END) AS BIGINT) AS reused_bytes FROM m")
def overlay_stats(spark: SparkSession, d: str) -> DataFrame:
    bytes_kept = F.sum(F.when(~F.col("overridden"), F.octet_length("o_orderstatus")).otherwise(0))
    return _overlay(spark, d).agg(F.count(F.lit(1)).alias("parts"), F.count_if("overridden").alias("overridden"), bytes_kept.alias("reused_bytes"))


@query(
    """SELECT l_orderkey, sha256(string_agg(item, '' ORDER BY l_linenumber, item)) AS fingerprint FROM (
    SELECT l_orderkey, l_linenumber, length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey || length(CAST(l_suppkey AS VARCHAR)) || ':' || l_suppkey || length(l_returnflag) || ':' || l_returnflag AS item FROM lineitem) GROUP BY l_orderkey"""
)
def dependency_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of an order's lines in order, each value behind its length."""
    item = revisions.length_prefixed(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag"))
    return revisions.fingerprint(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], item)


@query("SELECT doc_id, substr(sha256('document' || chr(10) || length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || length(text) || ':' || text), 1, 32) AS stable_id FROM documents")
def stable_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", revisions.stable_id("document", F.col("doc_id"), F.col("text")).alias("stable_id"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Schema' WHEN p_size % 3 = 0 THEN 'Template' WHEN p_size % 5 = 0 THEN 'Engine' WHEN p_size % 7 = 0 THEN 'Incomplete' ELSE 'Reuse' END AS decision FROM part"""
)
def plan_reuse(spark: SparkSession, d: str) -> DataFrame:
    """The first check that fails, in order, else reuse."""
    checks = [(n, F.col("p_size") % k != 0) for n, k in (("Schema", 2), ("Template", 3), ("Engine", 5), ("Incomplete", 7))]
    return table(spark, d, "part").select("p_partkey", revisions.first_reason(checks, "Reuse").alias("decision"))


@query(
    """SELECT o_orderkey, CAST(copy AS INTEGER) AS copy, 100000000 + row_number() OVER (ORDER BY o_orderkey, copy) AS new_id FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 4)) AS copy FROM orders)"""
)
def slide_copies(spark: SparkSession, d: str) -> DataFrame:
    """n copies of a slide, none for 0; new ids run on from a base without gaps.

    The numbers come in two steps, so that no task orders all copies: a sum over
    ranges of keys, then a count inside each range.
    """
    from pyspark.sql import Window

    chosen = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("int").alias("n")).filter("n > 1")
    chosen = chosen.withColumn("block", F.floor(F.col("o_orderkey") / 10_000))
    sums = chosen.groupBy("block").agg(F.sum(F.col("n") - 1).alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 10 000 keys
    bases = sums.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    copies = chosen.select("o_orderkey", "block", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("copy"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("o_orderkey", "copy"))
    return copies.withColumn("inside", inside).join(bases, "block").select("o_orderkey", "copy", (F.lit(100_000_000) + F.col("base") + F.col("inside")).cast("long").alias("new_id"))


@query(
    """SELECT o_orderkey, 'MISSING_CUSTOMER' AS code, 'error' AS severity FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT o_orderkey, 'EMPTY_ORDER', 'warning' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT o_orderkey, 'NEGATIVE_TOTAL', 'error' FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT l_orderkey, 'DUPLICATE_ID', 'error' FROM (SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1))
    UNION ALL SELECT DISTINCT l_orderkey, 'MISSING_PART', 'error' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) UNION ALL SELECT l_orderkey, 'TOO_MANY_ROWS', 'warning' FROM lineitem GROUP BY 1 HAVING count(*) > 6"""
)
def plan_validation(spark: SparkSession, d: str) -> DataFrame:
    """One query for each rule, and their diagnostics together."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    say = lambda df, code, severity: df.select("o_orderkey", F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    lost = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    empty = orders.join(lines.select("o_orderkey"), "o_orderkey", "left_anti")
    twice = lines.groupBy("o_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("o_orderkey").distinct()
    parts = table(spark, d, "part").filter("p_size > 2").select(F.col("p_partkey").alias("l_partkey"))
    partless = lines.select("o_orderkey", "l_partkey").join(parts, "l_partkey", "left_anti").select("o_orderkey").distinct()
    many = lines.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 6")
    rules = (
        (lost, "MISSING_CUSTOMER", "error"),
        (empty, "EMPTY_ORDER", "warning"),
        (orders.filter("o_totalprice < 1000"), "NEGATIVE_TOTAL", "error"),
        (twice, "DUPLICATE_ID", "error"),
        (partless, "MISSING_PART", "error"),
        (many, "TOO_MANY_ROWS", "warning"),
    )
    return reduce(DataFrame.unionByName, (say(*rule) for rule in rules))
