"""Queries on aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..registry import query, table
from .tables_and_joins import _ROWS, LINE_ORDER

_KINDS = ["click", "view", "purchase"]


@query(
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, "
    + ", ".join(f"CAST(sum(CASE WHEN event_type = '{k}' THEN CAST(value AS DECIMAL(18, 4)) END) AS DOUBLE) AS {k}" for k in _KINDS)
    + " FROM events GROUP BY 1"
)
def chart_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Categories by series; the series are named, so no extra pass looks for them."""
    rows = table(spark, d, "events").select(F.col("ts").cast("date").cast("string").alias("day"), "event_type", F.col("value").cast("decimal(18,4)").alias("value"))
    wide = rows.groupBy("day").pivot("event_type", _KINDS).agg(F.sum("value"))
    return wide.select("day", *(F.col(k).cast("double").alias(k) for k in _KINDS))


def _series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("value"))


_SERIES = "s AS (SELECT c_nationkey, c_mktsegment, sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS value FROM customer GROUP BY 1, 2)"


@query(f"WITH {_SERIES} SELECT c_mktsegment, CAST(least(0, min(value)) AS DOUBLE) AS low, CAST(greatest(1, max(value)) AS DOUBLE) AS high FROM s GROUP BY c_mktsegment")
def chart_bounds_standard(spark: SparkSession, d: str) -> DataFrame:
    bounds = _series(spark, d).groupBy("c_mktsegment").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return bounds.select("c_mktsegment", F.least(F.lit(0), "a").cast("double").alias("low"), F.greatest(F.lit(1), "b").cast("double").alias("high"))


@query(
    f"""WITH {_SERIES}, c AS (SELECT c_nationkey, sum(CASE WHEN value < 0 THEN value ELSE 0 END) AS minus, sum(CASE WHEN value > 0 THEN value ELSE 0 END) AS plus FROM s GROUP BY 1)
    SELECT CAST(least(0, min(minus)) AS DOUBLE) AS low, CAST(greatest(1, max(plus)) AS DOUBLE) AS high FROM c"""
)
def chart_bounds_stacked(spark: SparkSession, d: str) -> DataFrame:
    side = lambda test: F.sum(F.when(test, F.col("value")).otherwise(0))
    sums = _series(spark, d).groupBy("c_nationkey").agg(side(F.col("value") < 0).alias("minus"), side(F.col("value") > 0).alias("plus"))
    return sums.agg(F.least(F.lit(0), F.min("minus")).cast("double").alias("low"), F.greatest(F.lit(1), F.max("plus")).cast("double").alias("high"))


@query(
    f"""WITH {_SERIES}, c AS (SELECT c_nationkey, CAST(sum(CASE WHEN value < 0 THEN value ELSE 0 END) AS DOUBLE) AS minus, CAST(sum(CASE WHEN value > 0 THEN value ELSE 0 END) AS DOUBLE) AS plus, greatest(CAST(sum(abs(value)) AS DOUBLE), 1.0) AS whole FROM s GROUP BY 1)
    SELECT least(0.0, min(round(minus / whole, 9))) AS low, greatest(1.0, max(round(plus / whole, 9))) AS high FROM c"""
)
def chart_bounds_percent(spark: SparkSession, d: str) -> DataFrame:
    side = lambda test: F.sum(F.when(test, F.col("value")).otherwise(0)).cast("double")
    sums = _series(spark, d).groupBy("c_nationkey").agg(side(F.col("value") < 0).alias("minus"), side(F.col("value") > 0).alias("plus"), F.greatest(F.sum(F.abs("value")).cast("double"), F.lit(1.0)).alias("whole"))
    share = lambda c: F.round(F.col(c) / F.col("whole"), 9)
    return sums.agg(F.least(F.lit(0.0), F.min(share("minus"))).alias("low"), F.greatest(F.lit(1.0), F.max(share("plus"))).alias("high"))


@query(
    f"""SELECT l_orderkey, CAST(rn AS INTEGER) AS row_no, CAST(cur AS BIGINT) AS cursor, CASE WHEN st < cur OR en <= st THEN 'duplicate' WHEN st > cur THEN 'gap' ELSE 'ok' END AS verdict
    FROM (SELECT *, coalesce(max(en) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur
      FROM (SELECT l_orderkey, {_ROWS} AS rn, l_linenumber - 1 AS st, l_linenumber AS en FROM lineitem))"""
)
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers of an order as slices that should cover it without gap or repeat."""
    rows = table(spark, d, "lineitem").withColumn("row_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))
    rows = rows.select("l_orderkey", "row_no", (F.col("l_linenumber") - 1).cast("long").alias("st"), F.col("l_linenumber").cast("long").alias("en"))
    return windows.coverage(rows, ["l_orderkey"], ["row_no"], "st", "en").select("l_orderkey", "row_no", "cursor", "verdict")


@query("SELECT user_id, event_id, previous, value FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous > value")
def source_order(spark: SparkSession, d: str) -> DataFrame:
    return windows.decreasing(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "previous", "value")


@query(
    """SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island
    FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS ch FROM events)) GROUP BY 1, 2, 3"""
)
def consecutive_groups(spark: SparkSession, d: str) -> DataFrame:
    out = windows.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(
    """SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"""
)
def adjacent_relation(spark: SparkSession, d: str) -> DataFrame:
    out = windows.neighbours(table(spark, d, "conversations"), ["conv_id"], ["turn"], ["role", "turn"])
    return out.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", "next_turn")


_WEIGHT = "(c_custkey % 17 + 1)"


@query(
    f"""SELECT c_custkey, c_nationkey, CAST(CASE WHEN rn = n THEN greatest(1, 100000 - coalesce(used, 0)) ELSE part END AS BIGINT) AS share FROM (
    SELECT *, sum(part) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM (
    SELECT c_custkey, c_nationkey, greatest(1, 100000 * {_WEIGHT} // sum({_WEIGHT}) OVER (PARTITION BY c_nationkey)) AS part, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer))"""
)
def proportional_split(spark: SparkSession, d: str) -> DataFrame:
    """100 000 units shared out by weight, the last member taking the rest."""
    return windows.shares(table(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], F.col("c_custkey") % 17 + 1, 100_000)


@query("SELECT DISTINCT k FROM ((SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))")
def set_symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.revisions import symmetric_difference

    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return symmetric_difference(a.distinct(), b.distinct())


@query("SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS sources FROM nation GROUP BY n_regionkey")
def reverse_dependencies(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))
    return lists.select("n_regionkey", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("sources"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') AND bool_or(o_orderstatus = 'F') THEN 'Mixed' WHEN bool_or(o_orderstatus = 'O') THEN 'Open' WHEN bool_or(o_orderstatus = 'F') THEN 'Finished' ELSE 'Unknown' END AS evidence FROM orders GROUP BY 1"""
)
def conformance_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Two or-folds to a four-valued verdict."""
    seen = table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("a"), F.bool_or(F.col("o_orderstatus") == "F").alias("b"))
    verdict = F.when(F.col("a") & F.col("b"), "Mixed").when(F.col("a"), "Open").when(F.col("b"), "Finished").otherwise("Unknown")
    return seen.select("o_custkey", verdict.alias("evidence"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 0 THEN 'Other' WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'Combination' END AS kind FROM lineitem GROUP BY 1")
def chart_kind(spark: SparkSession, d: str) -> DataFrame:
    """One kind, many or none: equal least and greatest values need no distinct count."""
    ends = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    kind = F.when(F.col("a").isNull(), "Other").when(F.col("a") == F.col("b"), F.col("a")).otherwise("Combination")
    return ends.select("l_orderkey", kind.alias("kind"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank order statistics."""
    return windows.order_statistics(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(
    """WITH p AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT user_id, max(n) AS most, min(n) AS least, round((max(n) - min(n)) / CAST(max(n) AS DOUBLE), 9) AS imbalance, CAST(sum(CASE WHEN n > prev THEN n - prev ELSE 0 END) AS BIGINT) AS increase
    FROM (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM p) GROUP BY user_id"""
)
def balance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Imbalance over pages and how far they grow in order."""
    pages = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    pages = pages.withColumn("prev", F.lag("n").over(Window.partitionBy("user_id").orderBy("day")))
    return pages.groupBy("user_id").agg(
        F.max("n").alias("most"),
        F.min("n").alias("least"),
        F.round((F.max("n") - F.min("n")) / F.max("n"), 9).alias("imbalance"),
        F.sum(F.when(F.col("n") > F.col("prev"), F.col("n") - F.col("prev")).otherwise(0)).alias("increase"),
    )


@query(
    """SELECT user_id, event_id, CAST(held AS BIGINT) AS held FROM (SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events WHERE length(props) <= 200) WHERE held <= 200"""
)
def budget_eviction(spark: SparkSession, d: str) -> DataFrame:
    """The newest events of a user that fit a byte budget."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.char_length("props").alias("bytes"))
    return windows.within_budget(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], "bytes", 200).select("user_id", "event_id", "held")


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CAST(event_id % 3 AS INTEGER) AS lvl, event_type <> 'view' AS num, CAST(event_id % 4 AS INTEGER) AS st FROM events),
    i AS (SELECT *, coalesce(CASE lvl WHEN 0 THEN 0 WHEN 1 THEN sum(CASE WHEN num AND lvl < 1 THEN 1 ELSE 0 END) OVER w ELSE sum(CASE WHEN num AND lvl < 2 THEN 1 ELSE 0 END) OVER w END, 0) AS isl FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, event_id, CASE WHEN num THEN CAST(first_value(greatest(st, 1)) OVER o + row_number() OVER o - 1 AS INTEGER) END AS number FROM i WINDOW o AS (PARTITION BY user_id, lvl, isl, num ORDER BY ts, event_id)"""
)
def auto_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers of three levels; a lower level starts deeper ones again."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 3).cast("int").alias("lvl"), (F.col("event_type") != "view").alias("num"), (F.col("event_id") % 4).cast("int").alias("st"))
    return windows.auto_numbers(rows, ["user_id"], ["ts", "event_id"], "lvl", "num", "st", levels=3).select("user_id", "event_id", "number")


@query("SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CASE WHEN sum(n_chars) <= 100000 THEN 'ok' ELSE 'over' END AS verdict FROM documents GROUP BY 1, 2")
def bounded_total(spark: SparkSession, d: str) -> DataFrame:
    """Totals against a cap; what exceeds it is marked, not failed."""
    out = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return out.withColumn("verdict", F.when(F.col("chars") <= 100_000, "ok").otherwise("over"))


@query(
    """SELECT c_mktsegment, CAST(greatest(max(length(c_name)), 12) AS BIGINT) AS width, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS minus, count(*) AS n FROM customer GROUP BY 1"""
)
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Widest text of each column against its header."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.greatest(F.max(F.char_length("c_name")), F.lit(12)).cast("long").alias("width"), F.count_if(F.col("c_acctbal") < 0).alias("minus"), F.count(F.lit(1)).alias("n"))
