"""Queries on package XML, frames, assignments and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, xml
from ..operators import layouts
from ..registry import query, table


def _in_order(df: DataFrame, key: str, order: str, piece: Column, head: str, tail: str) -> DataFrame:
    """One text for each key: its pieces in order between head and tail."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))).alias("l"))
    return rows.select(key, F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["p"]), ""), F.lit(tail)).alias("xml"))


def _key(c: str) -> Column:
    return F.col(c).cast("string")


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS place, 'rId' || o_orderkey AS rel_id FROM orders")
def slide_list(spark: SparkSession, d: str) -> DataFrame:
    """Slides of each presentation in order, read from its XML."""
    piece = F.concat(F.lit('<p:sldId id="'), _key("o_orderkey"), F.lit('" r:id="rId'), _key("o_orderkey"), F.lit('"/>'))
    docs = _in_order(table(spark, d, "orders"), "o_custkey", "o_orderkey", piece, '<p:presentation xmlns:p="urn:p" xmlns:r="urn:r"><p:sldIdLst>', "</p:sldIdLst></p:presentation>")
    return docs.select("o_custkey", F.posexplode(xml.slide_ids(F.col("xml"))).alias("place", "rel_id")).select("o_custkey", (F.col("place") + 1).alias("place"), "rel_id")


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS place, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'slide' || o_orderkey || '.xml' END AS part FROM orders")
def slide_order(spark: SparkSession, d: str) -> DataFrame:
    """Slides in presentation order with their parts, by presentation and relationship id; a missing relationship leaves a gap."""
    ids = slide_list(spark, d)
    rels = table(spark, d, "orders").filter("o_orderkey % 9 <> 0").select("o_custkey", F.concat(F.lit("rId"), _key("o_orderkey")).alias("rel_id"), F.concat(F.lit("slide"), _key("o_orderkey"), F.lit(".xml")).alias("part"))
    return ids.join(rels, ["o_custkey", "rel_id"], "left").select("o_custkey", "place", "part")


@query("SELECT conv_id, turn AS id, 'Shape ' || turn AS name, CASE WHEN turn % 2 = 0 THEN 'deck:text:id' || turn END AS description, role || ' & <' || turn || '>' || chr(10) || 'end' AS text FROM conversations")
def shape_scan(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of a slide with description and text, read from its XML."""
    run = lambda t: F.concat(F.lit("<a:r><a:t>"), text.escape_xml(t), F.lit("</a:t></a:r>"))
    described = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(' descr="deck:text:id'), _key("turn"), F.lit('"'))).otherwise("")
    body = F.concat(F.lit("<p:txBody><a:p>"), run(F.concat("role", F.lit(" & <"))), run(F.concat(_key("turn"), F.lit(">"))), F.lit("</a:p><a:p>"), run(F.lit("end")), F.lit("</a:p></p:txBody>"))
    piece = F.concat(F.lit('<p:sp><p:nvSpPr><p:cNvPr id="'), _key("turn"), F.lit('" name="Shape '), _key("turn"), F.lit('"'), described, F.lit("/></p:nvSpPr>"), body, F.lit("</p:sp>"))
    docs = _in_order(table(spark, d, "conversations"), "conv_id", "turn", piece, '<p:sld xmlns:p="urn:p" xmlns:a="urn:a"><p:cSld><p:spTree>', "</p:spTree></p:cSld></p:sld>")
    return docs.select("conv_id", F.explode(xml.shapes(F.col("xml"))).alias("s")).select("conv_id", "s.*")


@query(
    """SELECT o_custkey, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN 'bad id' ELSE 'b' || o_orderkey END AS id, CASE WHEN k <> 2 THEN 'text' END AS kind, CASE WHEN k <> 2 THEN 'ppt/slides/s.xml' END AS part, CASE WHEN k = 0 THEN o_orderkey END AS shape_id, CASE WHEN k IN (1, 3) THEN 'Title' END AS shape_name, CASE WHEN k > 1 THEN 'INVALID_MANIFEST' END AS code
    FROM (SELECT *, o_orderkey % 5 AS k FROM orders)"""
)
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Declared bindings; those that lack something needed say so."""
    k = F.col("o_orderkey") % 5
    name = F.when(k == 3, "bad id").otherwise(F.concat(F.lit("b"), _key("o_orderkey")))
    shape = F.when(k == 0, F.concat(F.lit(' shapeId="'), _key("o_orderkey"), F.lit('"'))).when(k.isin(1, 3), ' shapeName="Title"').when(k == 4, ' shapeId="none"').otherwise("")
    piece = F.concat(F.lit('<bind id="'), name, F.lit('" part="/ppt/slides/s.xml"'), F.when(k != 2, ' kind="text"').otherwise(""), shape, F.lit("/>"))
    docs = _in_order(table(spark, d, "orders"), "o_custkey", "o_orderkey", piece, "<bindings>", "</bindings>")
    return docs.select("o_custkey", F.explode(xml.manifest(F.col("xml"))).alias("b")).select("o_custkey", "b.*")


@query(
    """SELECT n_nationkey, slot, CASE WHEN slot = 'dk1' THEN '00' || printf('%04d', n_nationkey) WHEN slot = 'lt1' THEN 'FFFFFF' ELSE 'A0B0C' || n_regionkey END AS rgb, 'Font ' || n_name AS major, CASE WHEN n_nationkey % 2 = 0 THEN 'Mincho' END AS east_asian
    FROM nation, (SELECT unnest(['dk1', 'lt1', 'accent1', 'hlink']) AS slot)"""
)
def theme_facts(spark: SparkSession, d: str) -> DataFrame:
    """Colours by slot and the major font, read from a theme's XML."""
    srgb = lambda slot, v: F.concat(F.lit(f'<a:{slot}><a:srgbClr val="'), v, F.lit(f'"/></a:{slot}>'))
    rest = F.concat(F.lit("A0B0C"), _key("n_regionkey"))
    colors = F.concat(srgb("hlink", rest), srgb("dk1", F.concat(F.lit("00"), F.lpad(_key("n_nationkey"), 4, "0"))), F.lit('<a:lt1><a:sysClr val="window" lastClr="FFFFFF"/></a:lt1>'), srgb("accent1", rest), F.lit("<a:accent2/>"))
    asian = F.when(F.col("n_nationkey") % 2 == 0, '<a:ea typeface="Mincho"/>').otherwise("")
    fonts = F.concat(F.lit('<a:majorFont><a:latin typeface="Font '), "n_name", F.lit('"/>'), asian, F.lit('</a:majorFont><a:minorFont><a:latin typeface="Other"/></a:minorFont>'))
    doc = F.concat(F.lit('<a:theme xmlns:a="urn:a"><a:themeElements><a:clrScheme name="c">'), colors, F.lit('</a:clrScheme><a:fontScheme name="f">'), fonts, F.lit("</a:fontScheme></a:themeElements></a:theme>"))
    docs = table(spark, d, "nation").select("n_nationkey", doc.alias("xml"))
    out = docs.select("n_nationkey", F.explode(xml.theme_colors(F.col("xml"))).alias("c"), xml.theme_fonts(F.col("xml")).alias("f"))
    return out.select("n_nationkey", "c.slot", "c.rgb", F.col("f.major.latin").alias("major"), F.col("f.major.east_asian").alias("east_asian"))


@query(
    """SELECT p_partkey, CAST(slot AS INTEGER) AS slot, 1000 + CASE slot WHEN 0 THEN 0 WHEN 1 THEN a + 50 ELSE a + b + 100 END AS x, CASE slot WHEN 0 THEN a WHEN 1 THEN b ELSE 9144000 - a - b - 100 END AS width
    FROM (SELECT p_partkey, (9144000 - 100) * (p_size % 3 + 1) // (p_size % 3 + 4) AS a, (9144000 - 100) * 2 // (p_size % 3 + 4) AS b FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)), (SELECT unnest([0, 1, 2]) AS slot)"""
)
def frame_division(spark: SparkSession, d: str) -> DataFrame:
    """Three columns by weight with gaps; the last takes what division leaves."""
    weights = F.array((F.col("p_size") % 3 + 1).cast("long"), F.lit(2).cast("long"), F.lit(1).cast("long"))
    parts = layouts.divided(F.lit(1000), F.lit(9_144_000), F.lit(50), weights)
    out = table(spark, d, "part").select("p_partkey", F.posexplode(parts).alias("slot", "p"))
    return out.select("p_partkey", "slot", F.col("p.start").alias("x"), F.col("p.extent").alias("width"))


@query(
    """WITH RECURSIVE r AS (SELECT n_nationkey AS k, n_nationkey % 13 AS groups, least(n_nationkey % 5, n_nationkey % 13) AS used FROM nation WHERE n_nationkey % 13 > 0 AND n_nationkey % 5 > 0),
    c AS (SELECT k, groups, used, CAST([] AS INTEGER[]) AS cuts FROM r UNION ALL SELECT k, groups, used, list_append(cuts, cut) FROM (SELECT *, unnest(range(coalesce(cuts[-1], 0) + 1, CAST(groups - (used - len(cuts) - 1) + 1 AS INTEGER))) AS cut FROM c WHERE len(cuts) < used - 1))
    SELECT k AS n_nationkey, CAST(row_number() OVER (PARTITION BY k ORDER BY cuts) AS INTEGER) AS number, array_to_string(cuts, ',') AS cuts FROM c WHERE len(cuts) = used - 1 QUALIFY number <= 256"""
)
def slot_assignments(spark: SparkSession, d: str) -> DataFrame:
    """All ways to deal groups in order to slots."""
    asked = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 13).alias("groups"), (F.col("n_nationkey") % 5).alias("slots"))
    return layouts.assignments(asked, "n_nationkey").select("n_nationkey", "number", F.array_join("cuts", ",").alias("cuts"))


_SLOTS = "(SELECT o_custkey, o_orderkey AS slot, greatest(0, least(o_orderkey % 700 - 100, o_orderkey % 400 + 50)) AS used, o_orderkey % 400 + 50 AS height, o_orderkey % 7 AS reduction FROM orders)"


@query(
    f"""SELECT o_custkey, max(reduction) AS reduction, (max(used) - min(used)) * 1000 // greatest(1, max(used)) AS imbalance, CAST((greatest(1, sum(height)) - least(sum(used), greatest(1, sum(height)))) * 1000 // greatest(1, sum(height)) AS BIGINT) ** 2 AS whitespace, CAST(sum(rise) AS BIGINT) AS order_balance
    FROM (SELECT *, greatest(0, coalesce(used - lag(used) OVER (PARTITION BY o_custkey ORDER BY slot), 0)) AS rise FROM {_SLOTS}) GROUP BY o_custkey""".replace("AS BIGINT) ** 2 AS whitespace", "AS BIGINT) AS share").replace("SELECT o_custkey, max", "SELECT o_custkey, reduction, imbalance, share * share AS whitespace, order_balance FROM (SELECT o_custkey, max") + ")"
)
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Balance, unused room and order of each candidate from its slots."""
    key = F.col("o_orderkey")
    slots = table(spark, d, "orders").select("o_custkey", key.alias("slot"), F.lit(100).alias("y"), (key % 400 + 50).alias("height"), (key % 700).alias("cursor"), (key % 7).alias("reduction"))
    return layouts.scores(slots, ["o_custkey"])


@query("SELECT n_regionkey, n_nationkey FROM nation UNION ALL SELECT n_regionkey, 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def node_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all nodes of trees two levels deep, one row each."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey"), "n_regionkey")
    children = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list((F.col("s_suppkey") + 1000).cast("long")).alias("children"))
    trees = nation.join(children, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_regionkey", F.struct(F.col("n_nationkey").cast("long").alias("id"), F.coalesce("children", F.array().cast("array<bigint>")).alias("children")).alias("node"))
    flat = F.concat(F.array("node.id"), F.col("node.children"))
    return trees.select("n_regionkey", F.explode(flat).alias("n_nationkey"))
