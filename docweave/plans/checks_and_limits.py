"""Queries on coverage, growth, overlaps, active parts, pruning and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wrapping
from ..operators import charts, joins, layouts, revisions, validation, windows
from ..registry import query, table
from ..sources import packages


@query(
    """WITH s AS (SELECT conv_id, turn, turn * 10 + CASE WHEN turn % 7 = 3 THEN 2 ELSE 0 END AS st, turn * 10 + 10 + CASE WHEN turn % 5 = 4 THEN 3 ELSE 0 END AS en FROM conversations),
    x AS (SELECT conv_id, max(turn) * 10 + 10 + CASE WHEN conv_id % 4 = 1 THEN 5 ELSE 0 END AS extent FROM conversations GROUP BY 1),
    c AS (SELECT *, coalesce(max(en) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM s),
    p AS (SELECT conv_id, sum(CASE WHEN st > cur THEN 1 ELSE 0 END) AS gaps, sum(CASE WHEN st < cur OR en <= st THEN 1 ELSE 0 END) AS dup, max(en) AS e FROM c GROUP BY 1)
    SELECT * FROM (SELECT conv_id, CAST(gaps + CASE WHEN e <> extent THEN 1 ELSE 0 END AS BIGINT) AS losses, CAST(dup AS BIGINT) AS duplications FROM p JOIN x USING (conv_id)) WHERE losses > 0 OR duplications > 0"""
)
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Texts that their slices miss or hold twice, ends included."""
    turn = F.col("turn").cast("long")
    turns = table(spark, d, "conversations")
    slices = turns.select("conv_id", "turn", (turn * 10 + F.when(turn % 7 == 3, 2).otherwise(0)).alias("st"), (turn * 10 + 10 + F.when(turn % 5 == 4, 3).otherwise(0)).alias("en"))
    extents = turns.groupBy("conv_id").agg((F.max(turn) * 10 + 10).alias("e")).select("conv_id", (F.col("e") + F.when(F.col("conv_id") % 4 == 1, 5).otherwise(0)).alias("extent"))
    return windows.coverage_report(slices, extents, ["conv_id"], ["turn"], "st", "en", "extent")


@query(
    """WITH m AS (SELECT p_brand, p_size, sum(p_retailprice) AS bytes, count(*) AS n FROM part GROUP BY 1, 2), a AS (SELECT * FROM m WHERE p_size <= 25), b AS (SELECT * FROM m WHERE p_size > 25)
    SELECT a.p_brand, a.p_size AS small, b.p_size AS large, round((b.bytes / a.bytes) / (CAST(b.p_size AS DOUBLE) / a.p_size), 6) AS growth, CASE WHEN (b.bytes / a.bytes) / (CAST(b.p_size AS DOUBLE) / a.p_size) > 1.5 THEN 'above' ELSE 'ok' END AS verdict FROM a JOIN b ON a.p_brand = b.p_brand AND b.p_size = a.p_size + 25"""
)
def growth_budget(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a small and a large run against the growth of their inputs."""
    runs = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").alias("bytes"))
    small = runs.filter("p_size <= 25").select("p_brand", F.col("p_size").alias("small"), F.col("bytes").alias("few"), (F.col("p_size") + 25).alias("large"))
    both = small.join(runs.filter("p_size > 25").select("p_brand", F.col("p_size").alias("large"), F.col("bytes").alias("many")), ["p_brand", "large"])
    growth = validation.normalized_growth(F.col("few"), F.col("many"), F.col("small"), F.col("large"))
    out = both.withColumn("growth", growth)
    return out.select("p_brand", "small", "large", F.round("growth", 6).alias("growth"), F.when(F.col("growth") > 1.5, "above").otherwise("ok").alias("verdict"))


@query(
    """SELECT package_id, "offset" FROM (SELECT o_custkey AS package_id, o_orderkey % 1000 * 10 AS "offset", lag(o_orderkey % 1000 * 10 + o_orderkey % 90) OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 1000 * 10, o_orderkey) AS before FROM orders) WHERE before > "offset" """
)
def entry_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a package that begin before the one before them ends."""
    key = F.col("o_orderkey")
    entries = table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), (key % 1000 * 10).alias("offset"), (key % 90).alias("csize"), key.alias("seq"))
    return packages.overlapping_entries(entries).select("package_id", "offset")


@query(
    """WITH p AS (SELECT p_brand, CASE p_partkey % 9 WHEN 0 THEN 'ppt/vbaProject' WHEN 1 THEN 'ppt/activeX/a' ELSE 'ppt/slides/s' END || p_partkey AS name, CASE WHEN p_partkey % 11 = 0 THEN 'application/vnd.macroEnabled' ELSE 'text/xml' END AS kind FROM part)
    SELECT p_brand, string_agg(name, ',' ORDER BY name) AS problems, min(name) AS first FROM p WHERE contains(lower(name || ' ' || kind), 'vbaproject') OR contains(lower(name), 'activex') OR contains(lower(kind), 'macroenabled') GROUP BY 1"""
)
def active_parts(spark: SparkSession, d: str) -> DataFrame:
    """The active parts of each package in order, and the first of them."""
    key = F.col("p_partkey")
    name = F.concat(F.when(key % 9 == 0, "ppt/vbaProject").when(key % 9 == 1, "ppt/activeX/a").otherwise("ppt/slides/s"), key.cast("string"))
    parts = table(spark, d, "part").select("p_brand", name.alias("name"), F.when(key % 11 == 0, "application/vnd.macroEnabled").otherwise("text/xml").alias("kind"))
    return validation.active_problems(parts, ["p_brand"], "name", "kind").withColumn("problems", F.array_join("problems", ","))


@query(
    """SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS place FROM (SELECT l_suppkey, l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2)) WHERE place <= 64"""
)
def pruned_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate page for each start and end, 64 ends for each start."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice")
    return joins.pruned(lines, ["l_suppkey"], ["l_orderkey"], [("l_extendedprice", True)])


_EIGHT = "reduction, crop, relation, imbalance, orphaning, whitespace, complexity, tie"


@query(
    f"""WITH s AS (SELECT o_custkey, o_orderstatus, o_orderkey AS slot, greatest(0, least(o_orderkey % 700 - 100, o_orderkey % 400 + 50)) AS used, o_orderkey % 400 + 50 AS height, o_orderkey % 3 AS reduction FROM orders),
    r AS (SELECT *, greatest(0, coalesce(used - lag(used) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY slot), 0)) AS rise FROM s),
    a AS (SELECT o_custkey, o_orderstatus, max(reduction) AS reduction, 0 AS crop, 0 AS relation, (max(used) - min(used)) * 1000 // greatest(1, max(used)) AS imbalance, CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS orphaning,
      CAST((sum(height) - least(sum(used), sum(height))) * 1000 // sum(height) AS BIGINT) AS share, length(o_orderstatus) AS complexity, sum(rise) AS tie FROM r GROUP BY 1, 2)
    SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY reduction, crop, relation, imbalance, orphaning, share * share, complexity, tie, o_orderstatus) AS n FROM a) WHERE n = 1"""
)
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidate with the least of eight keys, compared one after the other."""
    key = F.col("o_orderkey")
    slots = table(spark, d, "orders").select("o_custkey", "o_orderstatus", key.alias("slot"), F.lit(100).alias("y"), (key % 400 + 50).alias("height"), (key % 700).alias("cursor"), (key % 3).alias("reduction"))
    number = slots.groupBy("o_custkey", "o_orderstatus").agg(F.when(F.count(F.lit(1)) == 1, 1).otherwise(0).alias("orphaning"))
    scored = layouts.scores(slots, ["o_custkey", "o_orderstatus"]).join(number, ["o_custkey", "o_orderstatus"])
    scored = scored.withColumns({"crop": F.lit(0), "relation": F.lit(0), "complexity": F.char_length("o_orderstatus"), "tie": F.col("order_balance")})
    order = [(c, False) for c in (*_EIGHT.split(", "), "o_orderstatus")]
    return joins.first_by(scored, ["o_custkey"], order).select("o_custkey", "o_orderstatus")


@query(
    """WITH v AS (SELECT o_custkey, string_agg(x, '' ORDER BY o_orderkey) AS v FROM (SELECT *, length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey || length(o_orderpriority) || ':' || o_orderpriority AS x FROM orders) GROUP BY 1)
    SELECT c_custkey, substr(sha256('plan' || chr(10) || length(c_name) || ':' || c_name || length(c_mktsegment) || ':' || c_mktsegment || length(coalesce(v, '')) || ':' || coalesce(v, '') || '1:7'), 1, 32) AS plan_id FROM customer LEFT JOIN v ON o_custkey = c_custkey"""
)
def plan_identity(spark: SparkSession, d: str) -> DataFrame:
    """A plan's id over its deck, its template, all its nodes and its policy."""
    item = revisions.length_prefixed(F.col("o_orderkey"), F.col("o_orderpriority"))
    nodes = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("x")))), lambda n: n["x"]), "").alias("nodes"))
    decks = table(spark, d, "customer").join(nodes, F.col("c_custkey") == F.col("o_custkey"), "left")
    return decks.select("c_custkey", revisions.stable_id("plan", F.col("c_name"), F.col("c_mktsegment"), F.col("nodes"), F.lit(7)).alias("plan_id"))


def _chart(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's parts by type and size as a chart."""
    part = table(spark, d, "part")
    kinds = part.groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").alias("value"))
    return kinds.select("p_brand", F.floor((F.col("p_size") - 1) / 10).alias("category_no"), ((F.col("p_size") - 1) % 10).alias("series_no"), F.concat(F.lit("C"), F.floor((F.col("p_size") - 1) / 10).cast("string")).alias("category"), F.concat(F.lit("S"), ((F.col("p_size") - 1) % 10).cast("string")).alias("series"), F.round("value").cast("long").alias("value"))


_CHART = "c AS (SELECT p_brand, (p_size - 1) // 10 AS category_no, (p_size - 1) % 10 AS series_no, CAST(round(sum(p_retailprice)) AS BIGINT) AS value FROM part GROUP BY 1, 2, 3)"


@query(
    f"""WITH {_CHART}, x AS (SELECT DISTINCT p_brand, category_no + 2 AS "row", 1 AS col, 'C' || category_no AS value FROM c UNION ALL SELECT DISTINCT p_brand, 1, series_no + 2, 'S' || series_no FROM c UNION ALL SELECT p_brand, category_no + 2, series_no + 2, CAST(value AS VARCHAR) FROM c)
    SELECT p_brand, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS "column", value, chr(CAST(64 + col AS INTEGER)) || "row" AS cell FROM x"""
)
def chart_cells(spark: SparkSession, d: str) -> DataFrame:
    """The sheet behind each chart."""
    return charts.workbook_cells(_chart(spark, d), "p_brand")


@query(
    f"""WITH {_CHART}, n AS (SELECT p_brand, max(category_no) + 2 AS last FROM c GROUP BY 1)
    SELECT p_brand, series_no, 'Sheet1!$' || l || '$1' AS name_ref, 'Sheet1!$A$2:$A$' || last AS category_ref, 'Sheet1!$' || l || '$2:$' || l || '$' || last AS value_ref FROM (SELECT DISTINCT p_brand, series_no, chr(CAST(66 + series_no AS INTEGER)) AS l FROM c) JOIN n USING (p_brand)"""
)
def chart_references(spark: SparkSession, d: str) -> DataFrame:
    """Where each series stands in its sheet."""
    return charts.series_references(_chart(spark, d), "p_brand")


@query(f"WITH {_CHART}, n AS (SELECT p_brand, count(DISTINCT series_no) AS new_series FROM c GROUP BY 1) SELECT p_brand, CAST(8 + length(p_brand) % 2 + hash_no AS BIGINT) AS source_series, new_series, 'INVALID_CHART' AS code FROM (SELECT *, CAST(right(p_brand, 1) AS BIGINT) AS hash_no FROM n) WHERE 8 + length(p_brand) % 2 + hash_no <> new_series")
def refused_charts(spark: SparkSession, d: str) -> DataFrame:
    """Charts whose series and replacements differ in number."""
    brands = table(spark, d, "part").select("p_brand").distinct()
    sources = brands.select("p_brand", (F.lit(8) + F.char_length("p_brand") % 2 + F.substring("p_brand", -1, 1).cast("long")).alias("source_series"))
    return charts.refused_charts(sources, _chart(spark, d), "p_brand")


@query(
    """WITH w AS (SELECT c_custkey, unnest(['png', 'jpeg', 'gif']) AS extension FROM customer), p AS (SELECT c_custkey, 'png' AS extension, CASE WHEN c_custkey % 2 = 0 THEN 'image/png' ELSE 'image/x-png' END AS present FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'gif', 'image/gif' FROM customer WHERE c_nationkey > 10)
    SELECT c_custkey, extension, 'image/' || extension AS content_type, CASE WHEN present IS NULL THEN 'insert' ELSE 'replace' END AS action FROM w LEFT JOIN p USING (c_custkey, extension) WHERE present IS NULL OR present <> 'image/' || extension"""
)
def default_types(spark: SparkSession, d: str) -> DataFrame:
    """Content types that packages with new images need."""
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    wanted = customers.select("c_custkey", F.explode(F.array(F.lit("png"), F.lit("jpeg"), F.lit("gif"))).alias("extension")).withColumn("content_type", F.concat(F.lit("image/"), "extension"))
    png = customers.filter("c_custkey % 3 <> 0").select("c_custkey", F.lit("PNG").alias("extension"), F.when(F.col("c_custkey") % 2 == 0, "image/png").otherwise("image/x-png").alias("content_type"))
    gif = customers.filter("c_nationkey > 10").select("c_custkey", F.lit("gif").alias("extension"), F.lit("image/gif").alias("content_type"))
    return charts.default_type_patches(png.unionByName(gif), wanted, "c_custkey")


@query(
    """WITH t AS (SELECT user_id, event_id % 4 AS part, CASE event_type WHEN 'click' THEN 'urn:a' WHEN 'view' THEN 'urn:p' END AS element_ns, CASE WHEN event_id % 3 = 0 THEN 'urn:r' END AS attribute_ns FROM events)
    SELECT DISTINCT user_id, part, ns AS namespace FROM (SELECT user_id, part, element_ns AS ns FROM t UNION ALL SELECT user_id, part, attribute_ns FROM t) WHERE ns IS NOT NULL"""
)
def namespace_union(spark: SparkSession, d: str) -> DataFrame:
    """Namespaces that the elements and attributes of each part use, in one pass over its tokens."""
    element = F.when(F.col("event_type") == "click", "urn:a").when(F.col("event_type") == "view", "urn:p")
    attribute = F.when(F.col("event_id") % 3 == 0, "urn:r")
    tokens = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("part"), F.explode(F.array_compact(F.array(element, attribute))).alias("namespace"))
    return tokens.distinct()


@query(
    """SELECT user_id, count(*) AS entries, CAST(sum(CASE WHEN held <= 300 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN held > 300 THEN 1 ELSE 0 END) AS BIGINT) AS evicted
    FROM (SELECT user_id, sum(w) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS held FROM (SELECT *, 1 + event_id % 100 AS w FROM events)) GROUP BY 1"""
)
def cache_evictions(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a cache of 300 units keeps and those that it has let go, the oldest first."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (1 + F.col("event_id") % 100).alias("w"))
    kept = windows.within_budget(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], "w", 300).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))
    per = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("entries")).join(kept, "user_id", "left")
    return per.select("user_id", "entries", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("entries") - F.coalesce("kept", F.lit(0))).alias("evicted"))


@query(
    r"""WITH RECURSIVE w AS (SELECT conv_id, turn, 1 AS i, CAST('' AS VARCHAR) AS line, CAST([] AS VARCHAR[]) AS lines, regexp_extract_all(text, '\n|[ \t\r]+|[^ \t\r\n]+') AS l FROM conversations
      UNION ALL SELECT conv_id, turn, i + 1,
        CASE WHEN t = chr(10) THEN '' WHEN blank THEN CASE WHEN line = '' OR length(line || t) > 40 THEN '' ELSE line || t END WHEN length(t) > 40 THEN substr(t, (length(t) - 1) // 40 * 40 + 1) WHEN line <> '' AND length(line || t) > 40 THEN t ELSE line || t END,
        list_concat(CASE WHEN t = chr(10) OR (line <> '' AND length(line || t) > 40) THEN list_append(lines, regexp_replace(line, '\s+$', '')) ELSE lines END, CASE WHEN length(t) > 40 AND NOT blank THEN list_transform(range(0, (length(t) - 1) // 40), lambda k: substr(t, k * 40 + 1, 40)) ELSE [] END), l
      FROM (SELECT *, l[i] AS t, regexp_matches(l[i], '^[ \t\r]') AS blank FROM w WHERE i <= len(l)))
    SELECT conv_id, turn, array_to_string(CASE WHEN line <> '' OR len(lines) = 0 THEN list_append(lines, regexp_replace(line, '\s+$', '')) ELSE lines END, '|') AS lines FROM w WHERE i = len(l) + 1"""
)
def wrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns in lines of 40 signs."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(wrapping.wrapped(F.col("text"), 40), "|").alias("lines"))
