"""Queries on checks, maps, colours, references and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import joins, tables, validation
from ..registry import query, table


@query(
    """SELECT p_partkey, contains(lower(name || ' ' || ct), 'vbaproject') OR contains(lower(name || ' ' || ct), 'macroenabled') OR contains(lower(name || ' ' || ct), 'activex') OR contains(lower(name || ' ' || ct), 'oleobject') AS active
    FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'ppt/vbaProject.bin' WHEN 1 THEN 'ppt/activeX/a.xml' ELSE p_name END AS name, CASE p_size % 7 WHEN 0 THEN 'application/x.macroEnabled+xml' ELSE p_type END AS ct FROM part)"""
)
def active_content(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 5 == 0, "ppt/vbaProject.bin").when(F.col("p_size") % 5 == 1, "ppt/activeX/a.xml").otherwise(F.col("p_name"))
    kind = F.when(F.col("p_size") % 7 == 0, "application/x.macroEnabled+xml").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", validation.active_content(name, kind).alias("active"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'EMPTY' WHEN p_size % 6 = 1 THEN 'EXTENSION' WHEN p_size % 6 = 2 THEN 'CONTENT_TYPE' WHEN p_size % 6 = 3 THEN 'CONTENT_TYPE' ELSE 'ok' END AS verdict FROM part"""
)
def image_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 6
    extension = F.when(k == 1, "p.ng").otherwise("png")
    kind = F.when(k == 2, "text/plain").when(k == 3, "image/p ng").otherwise("image/png")
    return table(spark, d, "part").select("p_partkey", validation.image_verdict(extension, kind, F.when(k == 0, 0).otherwise(10)).alias("verdict"))


@query(
    """SELECT o_custkey, CASE WHEN n = 0 THEN 'EMPTY' WHEN o_custkey % 4 = 0 THEN 'LENGTH' ELSE 'ok' END AS verdict FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"""
)
def chart_validation(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"), F.collect_list("o_orderkey").alias("c"))
    values = F.when(F.col("o_custkey") % 4 == 0, F.concat("v", F.array(F.lit(1.0)))).otherwise(F.col("v"))
    return lists.select("o_custkey", validation.chart_verdict(values, F.col("c")).alias("verdict"))


@query(
    """SELECT p_partkey, (x >= 0 AND y >= 0 AND x + p_size <= 100 AND y + 30 <= 100) AS inside FROM (SELECT p_partkey, p_size, p_partkey % 90 AS x, (p_partkey * 3) % 90 AS y FROM part)"""
)
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    inner = (F.col("p_partkey") % 90, F.col("p_partkey") * 3 % 90, F.col("p_size"), F.lit(30))
    return table(spark, d, "part").select("p_partkey", validation.contained(inner, tuple(map(F.lit, (0, 0, 100, 100)))).alias("inside"))


@query(
    """SELECT e.k AS role, CAST(e.n AS BIGINT) AS required, coalesce(o.n, 0) AS observed FROM (VALUES ('user', 10), ('assistant', 10), ('system', 1), ('nobody', 2)) AS e(k, n) LEFT JOIN (SELECT role, count(*) AS n FROM conversations GROUP BY 1) o ON o.role = e.k WHERE coalesce(o.n, 0) <> e.n"""
)
def required_counts(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("user", 10), ("assistant", 10), ("system", 1), ("nobody", 2)], "role string, required long")
    return validation.required_counts(table(spark, d, "conversations").select("role"), expected, ["role"], "required")


@query(
    """SELECT event_type, n, CASE WHEN n > 210 THEN 'above' WHEN n < 190 THEN 'below' ELSE 'ok' END AS verdict FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)"""
)
def budget_evaluation(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("verdict", validation.budget_verdict(F.col("n"), F.lit(210), F.lit(190)))


@query("SELECT l_suppkey, count(*) AS refs, count(DISTINCT l_orderkey) AS owners, CASE WHEN count(*) = 1 THEN 'drop' ELSE 'keep' END AS original FROM lineitem GROUP BY 1")
def reference_count(spark: SparkSession, d: str) -> DataFrame:
    """How often each part is referred to; the last reference takes the part with it."""
    per = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("l_suppkey").agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("owners"))
    return out.withColumn("original", F.when(F.col("refs") == 1, "drop").otherwise("keep"))


@query("SELECT p_brand, max(p_partkey) AS max_id, max(p_partkey) + 1 AS next_id FROM part GROUP BY 1")
def max_shape_id(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_partkey").alias("max_id"))
    return out.withColumn("next_id", F.col("max_id") + 1)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'red' ELSE 'blue' END AS accent, CASE WHEN p_size % 3 = 0 THEN 'white' ELSE 'black' END AS text FROM part")
def color_override(spark: SparkSession, d: str) -> DataFrame:
    """Later entries of a map win over earlier ones."""
    base = F.map_from_arrays(F.array(F.lit("accent"), F.lit("text")), F.array(F.lit("blue"), F.lit("black")))
    own = F.map_from_arrays(F.array(F.lit("accent"), F.lit("text")), F.array(F.when(F.col("p_size") % 2 == 0, "red"), F.when(F.col("p_size") % 3 == 0, "white")))
    merged = F.map_zip_with(base, own, lambda k, a, b: F.coalesce(b, a))
    return table(spark, d, "part").select("p_partkey", merged.alias("m")).select("p_partkey", F.col("m")["accent"].alias("accent"), F.col("m")["text"].alias("text"))


@query(
    """SELECT p_partkey, CAST((255 * p_size + 0 * (100 - p_size) + 50) // 100 AS BIGINT) AS red, CAST((10 * p_size + 240 * (100 - p_size) + 50) // 100 AS BIGINT) AS green FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)"""
)
def color_mix(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", geometry.mix_channel(F.lit(0), F.lit(255), share).alias("red"), geometry.mix_channel(F.lit(240), F.lit(10), share).alias("green"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, n_rows FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS n_rows FROM lineitem WHERE l_returnflag = 'R') WHERE n = 1"""
)
def related_part(spark: SparkSession, d: str) -> DataFrame:
    """The first relation of a kind, with how many there are."""
    own = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    out = tables.numbered(own, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey"])
    return out.filter("row_no = 1").select("l_orderkey", "l_linenumber", "l_partkey", "n_rows")


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS line, count(*) AS n FROM conversations GROUP BY 1")
def run_concatenation(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a shape put together in order."""
    item = F.concat("role", F.lit(":"), F.char_length("text").cast("string"))
    out = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("runs"))
    return out.select("conv_id", F.array_join(F.transform("runs", lambda r: r["item"]), "|").alias("line"), F.size("runs").cast("long").alias("n"))


@query("SELECT DISTINCT o_orderpriority AS code, o_orderstatus AS part FROM orders ORDER BY 1, 2")
def distinct_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("part")).distinct()


@query(
    """SELECT text_key, CAST(n AS BIGINT) AS requests, CAST(width AS BIGINT) AS width FROM (SELECT text AS text_key, count(*) AS n, max(length(text) * 11) AS width FROM documents GROUP BY 1)"""
)
def measured_once(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text is measured once and the measure fans out."""
    requests = table(spark, d, "documents").select(F.col("text").alias("text_key"))
    measured = requests.groupBy("text_key").agg(F.count(F.lit(1)).alias("requests"))
    return measured.withColumn("width", (F.char_length("text_key") * 11).cast("long"))


@query(
    """SELECT o.o_orderkey, c.c_name AS value, CASE WHEN c.c_custkey IS NULL THEN 'MissingValue' ELSE 'ok' END AS verdict FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) c ON o.o_custkey = c.c_custkey"""
)
def binding_values(spark: SparkSession, d: str) -> DataFrame:
    """Every binding must find its value."""
    values = table(spark, d, "customer").filter("c_custkey % 9 <> 0").select("c_custkey", "c_name")
    out = table(spark, d, "orders").join(values, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("o_orderkey", F.col("c_name").alias("value"), F.when(F.col("c_custkey").isNull(), "MissingValue").otherwise("ok").alias("verdict"))


@query("SELECT p_partkey, p_brand FROM part p WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = p.p_size)")
def active_tables(spark: SparkSession, d: str) -> DataFrame:
    """Bindings below a supplied table are left out."""
    given = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_size"))
    return table(spark, d, "part").join(given, "p_size", "left_anti").select("p_partkey", "p_brand")


@query("SELECT k FROM (SELECT n_name AS k FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer)")
def key_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys over several maps."""
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return one("nation", "n_name").unionByName(one("region", "r_name")).unionByName(one("customer", "c_mktsegment")).distinct()


@query(
    """SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END), max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END), 'none') AS style, count(*) AS n FROM orders GROUP BY 1"""
)
def style_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first layer that gives a style, in one pass."""
    layer = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(layer("O"), layer("F"), F.lit("none")).alias("style"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT user_id, event_id, sess FROM (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL '1 hour' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sess FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))"""
)
def edit_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of edits with at most an hour between them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL '1' HOUR"))
    out = table(spark, d, "events").withColumn("new", F.when(gap, 1).otherwise(0))
    return out.select("user_id", "event_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sess"))


@query(
    """SELECT l_orderkey, l_partkey, min(p_type) AS resource, CASE WHEN min(p_type) IS NULL THEN 'MISSING_RESOURCE' END AS code FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_size < 5) ON l_partkey = p_partkey GROUP BY 1, 2"""
)
def media_resources(spark: SparkSession, d: str) -> DataFrame:
    """Nodes to resources; a node whose resource is missing stays and says so."""
    given = table(spark, d, "part").filter("p_size < 5").select("p_partkey", "p_type")
    nodes = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    out = nodes.join(given, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("l_orderkey", "l_partkey", F.col("p_type").alias("resource"), F.when(F.col("p_partkey").isNull(), "MISSING_RESOURCE").alias("code"))


@query(
    """SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1"""
)
def layout_choice(spark: SparkSession, d: str) -> DataFrame:
    """The region with most room for each layout."""
    return joins.first_by(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], [("p_size", True), ("p_partkey", False)])
