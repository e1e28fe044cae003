"""Queries on row policies and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, tables, windows
from ..registry import query, table

#: ``lineitem`` has no key: rows are told apart by every column.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ROWS = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})"
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_COLS = ", ".join(_LINE)


@query(
    f"""SELECT {_COLS}, CAST(rn AS INTEGER) AS row_no, CAST((rn - 1) // 3 AS INTEGER) AS page, CAST((n + 2) // 3 AS INTEGER) AS pages,
    CASE WHEN n > 3 THEN CAST((rn - 1) // 3 + 1 AS VARCHAR) || '/' || CAST((n + 2) // 3 AS VARCHAR) END AS label
    FROM (SELECT *, {_ROWS} AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""
)
def table_continue(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each order in pages of three, with their labels."""
    out = tables.continued(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER, 3)
    return out.select(*_LINE, "row_no", "page", "pages", tables.page_label(F.col("page"), F.col("pages")).alias("label"))


@query(f"SELECT {_COLS}, CAST(rn AS INTEGER) AS row_no FROM (SELECT *, {_ROWS} AS rn FROM lineitem) WHERE rn <= 2")
def table_clip(spark: SparkSession, d: str) -> DataFrame:
    return tables.clipped(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER, 2).select(*_LINE, "row_no")


@query(
    """SELECT o_orderkey, o_custkey, CAST(n AS BIGINT) AS n_rows,
    CAST(CASE WHEN n > 8 THEN greatest(1, ceil((o_orderkey % 97 + 3) * 8 / n)) ELSE o_orderkey % 97 + 3 END AS BIGINT) AS height
    FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""
)
def table_shrink(spark: SparkSession, d: str) -> DataFrame:
    out = tables.shrunk(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderkey") % 97 + 3, 8)
    return out.select("o_orderkey", "o_custkey", "n_rows", "height")


@query("SELECT o_custkey, count(*) AS n_rows, 'INVALID_TABLE' AS code FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def table_fail(spark: SparkSession, d: str) -> DataFrame:
    return tables.overflowing(table(spark, d, "orders"), ["o_custkey"], 12).select("o_custkey", "n_rows", "code")


_TYPES = "parts AS (SELECT p_partkey, p_brand || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.' || CASE p_size % 4 WHEN 0 THEN 'XML' WHEN 1 THEN 'png' WHEN 2 THEN 'bin' ELSE 'rels' END AS name FROM part)"


@query(
    f"""WITH {_TYPES}
    SELECT p_partkey, name, CASE WHEN p_partkey % 10 = 0 THEN 'override/' || CAST(p_partkey % 7 AS VARCHAR) WHEN lower(name) LIKE '%.xml' THEN 'text/xml' WHEN name LIKE '%.png' THEN 'image/png' WHEN name LIKE '%.rels' THEN 'rels' END AS content_type,
    CASE WHEN p_partkey % 10 = 0 THEN 'Override' WHEN lower(name) LIKE '%.xml' OR name LIKE '%.png' OR name LIKE '%.rels' THEN 'Default' ELSE 'Missing' END AS source FROM parts"""
)
def content_type_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Overrides by name and defaults by extension; of repeated keys the last wins."""
    ending = F.element_at(F.array(F.lit("XML"), F.lit("png"), F.lit("bin"), F.lit("rels")), F.col("p_size") % 4 + 1)
    parts = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), ending).alias("name"))
    some = parts.filter("p_partkey % 10 = 0")
    overrides = some.select(F.concat(F.lit("/"), "name").alias("name"), F.lit("old").alias("content_type"), F.lit(-1).cast("long").alias("ord")).unionByName(
        some.groupBy("name").agg(F.max("p_partkey").alias("ord")).select("name", F.concat(F.lit("override/"), (F.col("ord") % 7).cast("string")).alias("content_type"), "ord")
    )
    defaults = spark.createDataFrame([("xml", "old", 0), ("XML", "text/xml", 1), ("png", "image/png", 2), ("rels", "rels", 3)], "extension string, content_type string, ord int")
    return joins.content_types(parts, overrides, defaults).select("p_partkey", "name", "content_type", "source")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'External' WHEN c_custkey IS NOT NULL THEN 'Internal' ELSE 'Missing' END AS kind, c_name AS target
    FROM orders LEFT JOIN customer ON o_custkey + (CASE WHEN o_orderkey % 11 = 0 THEN 10000000 ELSE 0 END) = c_custkey AND NOT o_orderpriority LIKE '1%'"""
)
def relationship_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Orders as relationships to customers: external, internal, or missing."""
    orders = table(spark, d, "orders").withColumn("target_id", F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 10_000_000).otherwise(0))
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    external = F.col("o_orderpriority").startswith("1")
    return joins.resolve(orders, customers, F.col("target_id") == F.col("c_custkey"), external, F.col("c_custkey")).select("o_orderkey", "kind", F.col("c_name").alias("target"))


@query(
    """WITH c AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS source FROM events),
    t AS (SELECT user_id, max(source) AS source FROM c GROUP BY user_id)
    SELECT c.user_id, CAST(c.source AS INTEGER) AS source, count(*) AS n, CASE WHEN count(*) = 1 THEN min(event_id) END AS binding, CASE WHEN count(*) > 1 THEN 'DuplicateId' END AS diagnostic
    FROM c JOIN t ON c.user_id = t.user_id AND c.source = t.source GROUP BY c.user_id, c.source"""
)
def binding_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Per id only candidates of the highest source count; one binds, more are a duplicate."""
    source = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    counted = table(spark, d, "events").groupBy("user_id", source.alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    best = counted.groupBy("user_id").agg(F.max(F.struct("source", "n", "first")).alias("top")).select("user_id", "top.*")
    return best.select("user_id", "source", "n", F.when(F.col("n") == 1, F.col("first")).alias("binding"), F.when(F.col("n") > 1, "DuplicateId").alias("diagnostic"))


_SELECTORS = "(VALUES (1, 5, NULL), (2, NULL, 'Brand#11'), (3, 7, 'Brand#99'), (4, 999999999, NULL), (5, NULL, 'no such brand'), (6, 12, NULL))"


@query(
    f"""SELECT CAST(s.selector AS INTEGER) AS selector, count(p_partkey) AS n_matches, min(p_partkey) AS first_match,
    CASE WHEN count(p_partkey) = 0 THEN 'MissingTarget' WHEN count(p_partkey) = 1 THEN 'Bound' ELSE 'AmbiguousTarget' END AS outcome
    FROM {_SELECTORS} AS s(selector, want_id, want_name) LEFT JOIN part ON (s.want_id IS NULL OR s.want_id = p_partkey) AND (s.want_name IS NULL OR s.want_name = p_brand) GROUP BY s.selector"""
)
def selector_match(spark: SparkSession, d: str) -> DataFrame:
    """Declared selectors against shapes: missing, bound or ambiguous."""
    rows = [(1, 5, None), (2, None, "Brand#11"), (3, 7, "Brand#99"), (4, 999_999_999, None), (5, None, "no such brand"), (6, 12, None)]
    declared = spark.createDataFrame(rows, "selector int, want_id long, want_name string")
    return joins.select_targets(declared, table(spark, d, "part").select("p_partkey", "p_brand"), "selector", ("want_id", "p_partkey"), ("want_name", "p_brand"))


@query(
    """WITH layout AS (SELECT p_brand, min(p_type) AS kind, CASE WHEN min(p_size) % 2 = 0 THEN min(p_size) END AS size FROM part GROUP BY p_brand),
    master AS (SELECT max(p_type) AS kind, max(p_size) AS size FROM part)
    SELECT p.p_partkey, coalesce(CASE WHEN p.p_size % 3 = 0 THEN p.p_type END, l.kind, m.kind) AS kind, coalesce(CASE WHEN p.p_size % 5 = 0 THEN p.p_size END, l.size, m.size) AS size
    FROM part p LEFT JOIN layout l ON p.p_brand = l.p_brand CROSS JOIN master m"""
)
def placeholder_inherit(spark: SparkSession, d: str) -> DataFrame:
    """Fields fall back from part to brand to the whole table."""
    part = table(spark, d, "part")
    layout = part.groupBy("p_brand").agg(F.min("p_type").alias("kind"), F.when(F.min("p_size") % 2 == 0, F.min("p_size")).alias("size"))
    master = part.agg(F.max("p_type").alias("kind"), F.max("p_size").alias("size")).withColumn("one", F.lit(1))
    own = part.select("p_partkey", "p_brand", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("kind"), F.when(F.col("p_size") % 5 == 0, F.col("p_size")).alias("size"), F.lit(1).alias("one"))
    return joins.inherit(own, [(layout, ["p_brand"]), (master, ["one"])], ["kind", "size"]).select("p_partkey", "kind", "size")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def unmaterialized_anti(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey")
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query(
    """WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, length(text) AS len FROM conversations),
    runs AS (SELECT conv_id, turn, e - len AS r_start, e AS r_end FROM r),
    tokens AS (SELECT conv_id, CAST(k AS BIGINT) AS token, k * 50 AS t_start, least(k * 50 + 30, total) AS t_end FROM (SELECT conv_id, total, unnest(range(0, CAST((total + 49) // 50 AS BIGINT))) AS k FROM (SELECT conv_id, max(e) AS total FROM r GROUP BY conv_id)))
    SELECT t.conv_id, t.token, turn, CAST(greatest(t_start, r_start) AS BIGINT) AS "start", CAST(least(t_end, r_end) AS BIGINT) AS "end" FROM tokens t JOIN runs USING (conv_id) WHERE t_start < r_end AND r_start < t_end"""
)
def span_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Token intervals cut at the runs they reach into."""
    runs = windows.running_offsets(table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("len")), ["conv_id"], ["turn"], "len")
    runs = runs.select("conv_id", "turn", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    totals = runs.groupBy("conv_id").agg(F.max("r_end").alias("total"))
    tokens = totals.select("conv_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 50))).alias("token")).filter("total > 0")
    tokens = tokens.select("conv_id", "token", (F.col("token") * 50).alias("t_start"), F.least(F.col("token") * 50 + 30, F.col("total")).alias("t_end"))
    return joins.spans_meeting(tokens, runs, ["conv_id"]).select("conv_id", "token", "turn", "start", "end")


_RECT = f"rects AS (SELECT l_orderkey, {_ROWS} AS id, CAST(l_quantity AS BIGINT) AS x, CAST(l_partkey % 50 AS BIGINT) AS y, CAST(l_suppkey % 20 AS BIGINT) AS w, CAST(l_linenumber * 4 AS BIGINT) AS h FROM lineitem)"


@query(
    f"""WITH {_RECT} SELECT a.l_orderkey, CAST(a.id AS INTEGER) AS id_a, CAST(b.id AS INTEGER) AS id_b FROM rects a JOIN rects b ON a.l_orderkey = b.l_orderkey AND a.id < b.id
    AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h WHERE a.w > 0 AND a.h > 0 AND b.w > 0 AND b.h > 0"""
)
def rect_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.numbered(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER)
    rects = rows.select("l_orderkey", F.col("row_no").alias("id"), F.col("l_quantity").cast("long").alias("x"), (F.col("l_partkey") % 50).alias("y"), (F.col("l_suppkey") % 20).alias("w"), (F.col("l_linenumber") * 4).cast("long").alias("h"))
    return joins.overlapping_rectangles(rects, ["l_orderkey"], ("x", "y", "w", "h"), "id")


@query(
    """WITH boxes AS (SELECT p_partkey AS id, p_size AS z, (p_partkey * 37) % 1000 AS x, (p_partkey * 91) % 1000 AS y, p_size * 2 AS w, p_size AS h FROM part),
    points AS (SELECT s_suppkey AS point_id, (s_suppkey * 13) % 1000 AS px, (s_suppkey * 29) % 1000 AS py FROM supplier)
    SELECT point_id, id, z FROM (SELECT point_id, id, z, row_number() OVER (PARTITION BY point_id ORDER BY z DESC, id DESC) AS n FROM points JOIN boxes ON px BETWEEN x AND x + w AND py BETWEEN y AND y + h) WHERE n = 1"""
)
def hit_test(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    boxes = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("z"), (F.col("p_partkey") * 37 % 1000).alias("x"), (F.col("p_partkey") * 91 % 1000).alias("y"), (F.col("p_size") * 2).alias("w"), F.col("p_size").alias("h"))
    points = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") * 13 % 1000).alias("px"), (F.col("s_suppkey") * 29 % 1000).alias("py"))
    return joins.hit(boxes, points).select("point_id", "id", "z")


@query(
    """WITH a AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_custkey FROM orders WHERE o_orderstatus = 'O'),
    b AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_custkey FROM orders WHERE o_orderstatus = 'F')
    SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CAST(coalesce(a.pos, b.pos) AS INTEGER) AS pos, a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.pos = b.pos"""
)
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """The i-th open order with the i-th finished one of a customer."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    side = lambda status, name: tables.numbered(orders.filter(F.col("o_orderstatus") == status), ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("row_no").alias("pos"), F.col("o_orderkey").alias(name))
    return side("O", "left_key").join(side("F", "right_key"), ["o_custkey", "pos"], "full")


@query(
    """SELECT p_partkey, l_suppkey, l_orderkey FROM (SELECT l_partkey AS p_partkey, l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1"""
)
def dominance_topk(spark: SparkSession, d: str) -> DataFrame:
    """The line that dominates each part and supplier."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey", "l_extendedprice", "l_linenumber")
    return joins.first_by(lines, ["p_partkey", "l_suppkey"], [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)]).select("p_partkey", "l_suppkey", "l_orderkey")


@query(
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1"""
)
def lexicographic_best(spark: SparkSession, d: str) -> DataFrame:
    """The least of a tuple of keys per customer, as one aggregate."""
    key = F.struct("o_orderpriority", (-F.col("o_totalprice")).alias("minus"), "o_orderkey")
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(key).alias("best"))
    return best.select("o_custkey", "best.o_orderkey", "best.o_orderpriority")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY l_orderkey")
def affected_parts(spark: SparkSession, d: str) -> DataFrame:
    """Semi join: lines of the orders in a delta."""
    delta = table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey")
    return table(spark, d, "lineitem").join(delta, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def ordering_join(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary lookups; the dictionaries are small and Spark's own size check broadcasts them."""
    out = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
