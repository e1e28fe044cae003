"""Queries on packages, tokens, slices, pages and live sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..functions.slices import text_slices as slices_of
from ..functions.text import escape_xml
from ..operators.pagination import paginate
from ..registry import query, table
from ..sources import packages
from ..streaming import sessions


@query(
    "SELECT conv_id AS package_id, 'turn' || turn || '.txt' AS name, octet_length(encode(text)) AS usize, true AS intact FROM (SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, text FROM conversations)"
)
def package_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as ZIP packages and scanned again: sizes and checksums hold."""
    parts = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("package_id"), F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "utf-8").alias("content"))
    scanned = packages.verified(packages.scan_entries(packages.write_packages(parts)))
    return scanned.select("package_id", "name", "usize", "intact")


@query("SELECT conv_id, turn, role, text AS content, CAST(1 AS BIGINT) AS elements FROM conversations")
def xml_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A turn as an XML element, its whole text escaped: the element, its attribute and the text come back from the tokens."""
    turns = table(spark, d, "conversations")
    xml = F.concat(F.lit("<t r='"), "role", F.lit("'>"), escape_xml(F.col("text")), F.lit("</t>"))
    rows = packages.token_rows(turns, xml, ["conv_id", "turn"])
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "Text", F.struct("seq", "name"))))
    content = F.array_join(F.transform(parts, lambda t: t["name"]), "")
    return rows.groupBy("conv_id", "turn").agg(F.max(F.col("attrs")["r"]).alias("role"), content.alias("content"), F.count_if(F.col("kind") == "Start").alias("elements"))


_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NO_SPACE = "[^" + _SPACE[1:]


@query(
    f"""WITH RECURSIVE marked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([.?!。？！])({_SPACE})', '\\1\x1d\\2', 'g'), '\n\n', '\n\x1d\n', 'g'), '\n\n', '\n\x1d\n', 'g') AS t FROM documents),
    pieces AS (SELECT doc_id, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS piece, unnest(l) AS rest FROM (SELECT doc_id, string_split(t, chr(29)) AS l FROM marked)),
    cut AS (SELECT doc_id, piece, 0 AS step, CAST('' AS VARCHAR) AS slice, rest FROM pieces
      UNION ALL SELECT doc_id, piece, step + 1, left(rest, n), substr(rest, n + 1) FROM (
        SELECT doc_id, piece, step, rest, CASE WHEN strlen(rest) <= 512 THEN length(rest) ELSE coalesce(nullif(length(regexp_extract(left(rest, most + 1), '(?s)^(.*{_SPACE}){_NO_SPACE}', 1)), 0), most) END AS n
        FROM (SELECT *, CASE WHEN strlen(rest) <= 512 THEN length(rest) ELSE list_max(list_filter(range(1, 513), lambda k: strlen(left(rest, k)) <= 512)) END AS most FROM cut WHERE rest <> '')))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece, step) AS INTEGER) AS place, slice FROM cut WHERE step > 0"""
)
def text_slices(spark: SparkSession, d: str) -> DataFrame:
    """Slices of whole texts: at sentences and blank lines, long stretches at line breaks."""
    cut = table(spark, d, "documents").select("doc_id", "text", F.posexplode(slices_of(F.col("text"))).alias("place", "s"))
    return cut.select("doc_id", (F.col("place") + 1).alias("place"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("slice"))


@query()
def pagination(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as blocks on pages of 1200 units; tests compare small decks with all ways to cut them."""
    blocks = table(spark, d, "conversations").select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("ord"), F.char_length("text").alias("height"))
    return paginate(blocks, 1200)


def _deltas(events: DataFrame) -> DataFrame:
    """Events as deltas: a user's session expects the revisions that its event numbers suggest, so some are stale."""
    return events.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") % 7 / 3).cast("long").alias("expected_revision"),
        (F.floor(F.col("event_id") % 7 / 3) + F.when(F.col("event_id") % 11 == 0, 2).otherwise(1)).cast("long").alias("next_revision"),
        F.col("event_type").alias("key"),
        F.col("value").cast("string").alias("value"),
        "ts",
    )


_DELTA_SQL = """deltas AS (SELECT user_id, event_id, CAST(event_id % 7 // 3 AS BIGINT) AS expected, CAST(event_id % 7 // 3 + CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS BIGINT) AS following, event_type AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"""


@query(
    f"""WITH RECURSIVE {_DELTA_SQL}, walk AS (
      SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS revision, CAST('' AS VARCHAR) AS status, CAST([] AS VARCHAR[]) AS keys FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT w.user_id, d.rn, d.event_id, CASE WHEN s = 'applied' THEN d.following ELSE w.revision END, s, CASE WHEN s = 'applied' THEN list_distinct(list_append(w.keys, d.key)) ELSE w.keys END
      FROM (SELECT w.*, CASE WHEN d.expected <> w.revision OR d.following <> d.expected + 1 THEN 'InvalidRevision' WHEN d.value < 0 THEN 'InvalidValue' ELSE 'applied' END AS s FROM walk w JOIN deltas d ON d.user_id = w.user_id AND d.rn = w.rn + 1) w JOIN deltas d ON d.user_id = w.user_id AND d.rn = w.rn + 1)
    SELECT user_id AS session_id, seq, revision, status, CAST(len(keys) AS INTEGER) AS n_keys FROM walk WHERE rn > 0"""
)
def live_session(spark: SparkSession, d: str) -> DataFrame:
    """Deltas through the stateful stream until the input is used up; negative values are refused and undone."""
    folder = graph.shared_folder(spark)
    base = f"{folder.rstrip('/')}/live-{uuid.uuid4().hex}"
    table(spark, d, "events").write.parquet(f"{base}/in")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{base}/in")
    sessions.run_to_end(sessions.live_sessions(_deltas(events), lambda key, value: float(value) >= 0), f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(sessions.OUT).parquet(f"{base}/out")


@query(
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS session_id, event_type AS key, value, n FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS w, row_number() OVER (PARTITION BY time_bucket(INTERVAL '1 hour', ts), user_id, event_type ORDER BY ts DESC, event_id DESC) AS last, count(*) OVER (PARTITION BY time_bucket(INTERVAL '1 hour', ts), user_id, event_type) AS n FROM events) WHERE last = 1"""
)
def edit_coalescing(spark: SparkSession, d: str) -> DataFrame:
    """Edits of one key within an hour become one, with the last value."""
    out = sessions.coalesced(_deltas(table(spark, d, "events")), "ts", "1 hour", "1 hour")
    return out.select("window_start", "session_id", "key", F.col("value").cast("double").alias("value"), "n")
