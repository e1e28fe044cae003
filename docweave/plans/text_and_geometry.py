"""Queries on text and geometry expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import revisions
from ..registry import query, table

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query(f"SELECT page_id, {_ESC.format('html')} AS escaped FROM pages")
def escape_xml(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.escape_xml(F.col("html")).alias("escaped"))


_REFERENCES = """SELECT page_id, CASE page_id % 7 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE html || chr(CAST(page_id % 50000 + 33 AS INTEGER)) || '<' || chr(CAST(128512 + page_id % 50 AS INTEGER)) END AS decoded,
  CASE page_id % 7 WHEN 1 THEN 'UNSUPPORTED' WHEN 2 THEN 'INVALID_NUMERIC' WHEN 3 THEN 'UNTERMINATED' END AS code FROM pages"""


@query(_REFERENCES)
def decode_entities(spark: SparkSession, d: str) -> DataFrame:
    """Escaped pages with decimal and hexadecimal references behind them, decoded again; some end in bad references."""
    key = F.col("page_id")
    decimal = F.concat(F.lit("&#"), (key % 50_000 + 33).cast("string"), F.lit(";&lt;"))
    wide = F.concat(F.lit("&#x"), F.hex(128_512 + key % 50), F.lit(";"))
    bad = F.when(key % 7 == 1, F.lit("&nbsp;")).when(key % 7 == 2, F.lit("&#xD800;")).when(key % 7 == 3, F.lit("&amp")).otherwise(F.lit(""))
    found = text.decode_entities(F.concat(text.escape_xml(F.col("html")), decimal, wide, bad))
    return table(spark, d, "pages").select("page_id", found.alias("f")).select("page_id", F.col("f.text").alias("decoded"), "f.code")


@query("SELECT page_id, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).select("page_id", (F.col("pos") + 1).alias("pos"), "href")


@query(
    r"""WITH a AS (SELECT p_partkey, regexp_replace(CASE p_size % 4 WHEN 0 THEN '../../../' || p_partkey WHEN 1 THEN '../media/./' || p_partkey || '.png#frag' WHEN 2 THEN '/root//' || p_brand ELSE 'sub/x/../' || p_partkey || '.xml' END, '#.*$', '') AS path FROM part),
    b AS (SELECT p_partkey, ltrim(regexp_replace(replace('/' || CASE WHEN path LIKE '/%' THEN path ELSE 'ppt/slides/' || path END, '/./', '/'), '/+', '/', 'g'), '/') AS w FROM a),
    c AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(w, '(^|/)[^/]+/\.\./', '\1'), '(^|/)[^/]+/\.\./', '\1'), '(^|/)[^/]+/\.\./', '\1') AS w FROM b)
    SELECT p_partkey, CASE WHEN w LIKE '../%' THEN NULL ELSE w END AS resolved FROM c"""
)
def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Relative targets seen from a slide: up, from the root, down, and out of the package."""
    key = F.col("p_partkey").cast("string")
    target = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("../../../"), key))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit("../media/./"), key, F.lit(".png#frag")))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("/root//"), F.col("p_brand")))
        .otherwise(F.concat(F.lit("sub/x/../"), key, F.lit(".xml")))
    )
    return table(spark, d, "part").select("p_partkey", text.resolve_path(F.lit("ppt/slides/slide1.xml"), target).alias("resolved"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a/' || p_brand || '/_rels/' || p_partkey || '.xml.rels' ELSE '_rels/' || p_partkey || '.rels' END AS rels, CASE WHEN p_size % 2 = 0 THEN 'a/' || p_brand || '/' || p_partkey || '.xml' ELSE CAST(p_partkey AS VARCHAR) END AS owner, CAST(NULL AS VARCHAR) AS owner_of_part FROM part")
def rels_path(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a/"), F.col("p_brand"), F.lit("/"), key, F.lit(".xml"))).otherwise(key)
    return table(spark, d, "part").select("p_partkey", text.rels_name(name).alias("rels"), text.owner_of_rels(text.rels_name(name)).alias("owner"), text.owner_of_rels(name).alias("owner_of_part"))


@query(
    """SELECT conv_id, turn, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS pos, unnest(l) AS token FROM (SELECT conv_id, turn, list_filter(regexp_extract_all('{{' || role || '.' || turn || '}} x {{bad id}} {{' || text || '}} {{turn_' || turn || '}}', '(?s)\\{\\{(.*?)\\}\\}', 1), lambda x: regexp_full_match(x, '[A-Za-z0-9_.-]{1,128}')) AS l FROM conversations)"""
)
def visible_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens between double braces whose ids are valid, left to right."""
    turn = F.col("turn").cast("string")
    line = F.concat(F.lit("{{"), "role", F.lit("."), turn, F.lit("}} x {{bad id}} {{"), "text", F.lit("}} {{turn_"), turn, F.lit("}}"))
    out = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.visible_tokens(line)).alias("pos", "token"))
    return out.select("conv_id", "turn", (F.col("pos") + 1).alias("pos"), "token")


@query(
    """SELECT doc_id, CAST(greatest(1, list_sum(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda p: ceil(greatest(length(p), 1) / 80.0)))) AS BIGINT) AS lines FROM documents"""
)
def line_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.line_count(F.col("text"), 80).cast("long").alias("lines"))


# the classes as the model states them, each without what an earlier one holds
_ADVANCE = " + ".join(
    f"{width} * (length(t) - length(regexp_replace(t, '{chars}', '', 'g')))"
    for chars, width in (
        (r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", 250),
        ("[ijlI|!.,:;''`]", 280),
        (r"[frt()\[\]{}/-]", 360),
        ("[mwMW@%&]", 850),
        ("[A-HJ-LN-VX-Z]", 650),
        ("[abcdeghknopqsuvxyz]", 520),
        ("[0-9]", 560),
        (r"[\x22#$*+<=>?\x5c^_~]", 400),
        (r"[^\x00-\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", 1000),
    )
)


@query(f"SELECT doc_id, CAST(({_ADVANCE}) * 2000 // 1000 AS BIGINT) AS advance FROM (SELECT doc_id, text AS t FROM documents)")
def text_advance(spark: SparkSession, d: str) -> DataFrame:
    """Advance of whole texts by classes of characters."""
    return table(spark, d, "documents").select("doc_id", text.class_width(F.col("text"), 2000).alias("advance"))


_LETTER = "chr(CAST(65 + (n - 1 - {0}) // {1} % 26 AS INTEGER))"
_COLUMN = f"""CASE WHEN n > 18278 THEN {_LETTER.format(18278, 17576)} ELSE '' END || CASE WHEN n > 702 THEN {_LETTER.format(702, 676)} ELSE '' END || CASE WHEN n > 26 THEN {_LETTER.format(26, 26)} ELSE '' END || CASE WHEN n > 0 THEN {_LETTER.format(0, 1)} ELSE '' END"""
_ORDINAL = "CAST(n AS VARCHAR) || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END"


@query(f"SELECT n, {_COLUMN} AS col, {_ORDINAL} AS ordinal FROM (SELECT p_partkey AS n FROM part)")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    """Spreadsheet columns and ordinals."""
    n = F.col("p_partkey")
    return table(spark, d, "part").select(n.alias("n"), text.spreadsheet_column(n).alias("col"), text.ordinal(n).alias("ordinal"))


def _tens(one: str, five: str, ten: str, unit: int) -> str:
    written = [one * k for k in range(4)] + [one + five] + [five + one * k for k in range(4)] + [one + ten]
    return "[" + ", ".join(f"'{w}'" for w in written) + f"][CAST(r // {unit} % 10 + 1 AS INTEGER)]"


_ROMAN = "['', 'M', 'MM', 'MMM'][CAST(r // 1000 + 1 AS INTEGER)] || " + " || ".join(_tens(*x) for x in (("C", "D", "M", 100), ("X", "L", "C", 10), ("I", "V", "X", 1)))


@query(f"SELECT n, {_ROMAN} AS roman, '(' || lower({_COLUMN}) || ')' AS alpha FROM (SELECT p_partkey AS n, least(p_partkey, 3999) AS r FROM part)")
def roman_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Roman numerals, and letters in parentheses."""
    n = F.col("p_partkey")
    return table(spark, d, "part").select(n.alias("n"), text.roman(n).alias("roman"), text.with_affix(text.alphabetic(n), "ParenBoth").alias("alpha"))


_SCHEMES = ("alphaLcParenR", "alphaUcPeriod", "romanLcParenBoth", "romanUcPeriod", "ordinal", "circleNumDbPlain", "arabicPeriod", "arabicPlain")


@query(
    f"""SELECT p_partkey, scheme, CASE WHEN scheme LIKE '%ParenBoth' THEN '(' || body || ')' WHEN scheme LIKE '%ParenR' THEN body || ')' WHEN scheme LIKE '%Period' THEN body || '.' ELSE body END AS label
    FROM (SELECT p_partkey, scheme, CASE WHEN scheme LIKE 'alphaLc%' THEN lower({_COLUMN}) WHEN scheme LIKE 'alphaUc%' THEN {_COLUMN} WHEN scheme LIKE 'romanLc%' THEN lower({_ROMAN}) WHEN scheme LIKE 'romanUc%' THEN {_ROMAN}
      WHEN scheme LIKE 'ordinal%' THEN {_ORDINAL} WHEN scheme LIKE 'circleNum%' AND n <= 20 THEN chr(CAST(9311 + n AS INTEGER)) ELSE CAST(n AS VARCHAR) END AS body
      FROM (SELECT p_partkey, p_size AS n, p_size AS r, {list(_SCHEMES)}[CAST(p_partkey % 8 + 1 AS INTEGER)] AS scheme FROM part))"""
)
def auto_number_formats(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph numbers in eight schemes."""
    scheme = F.element_at(F.array(*map(F.lit, _SCHEMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    out = table(spark, d, "part").select("p_partkey", "p_size", scheme.alias("scheme"))
    return out.select("p_partkey", "scheme", text.auto_number(F.col("p_size"), F.col("scheme")).alias("label"))


@query("SELECT doc_id, regexp_replace(text, '(^|\\n)([^\\n])', '\\1• \\2', 'g') AS marked FROM documents")
def paragraph_markers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.paragraph_markers(F.col("text")).alias("marked"))


_LINKS = "(SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'mailto:a@b.c' WHEN 2 THEN 'tel:+1' WHEN 3 THEN '#top' WHEN 4 THEN ' ' || url ELSE 'javascript:x' END AS url FROM pages)"


@query(
    f"""SELECT page_id, CASE WHEN url LIKE ' %' THEN NULL WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'Web' WHEN url LIKE 'mailto:%' THEN 'Email' WHEN url LIKE 'tel:%' THEN 'Telephone' WHEN url LIKE '#_%' THEN 'Anchor' END AS kind FROM {_LINKS}"""
)
def safe_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 6
    url = F.when(k == 0, F.col("url")).when(k == 1, "mailto:a@b.c").when(k == 2, "tel:+1").when(k == 3, "#top").when(k == 4, F.concat(F.lit(" "), "url")).otherwise("javascript:x")
    return table(spark, d, "pages").select("page_id", text.safe_link(url).alias("kind"))


@query(
    """SELECT p_partkey, name, NOT (name LIKE '/%' OR contains(name, '\\') OR regexp_matches(name, '(^|/)\\.\\.?(/|$)')) AS safe FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '/' || p_brand WHEN 1 THEN 'a/../' || p_brand WHEN 2 THEN 'a\\b' ELSE 'a/b.' || p_partkey END AS name FROM part)"""
)
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    name = F.when(k == 0, F.concat(F.lit("/"), "p_brand")).when(k == 1, F.concat(F.lit("a/../"), "p_brand")).when(k == 2, "a\\b").otherwise(F.concat(F.lit("a/b."), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), text.safe_name(name).alias("safe"))


_SIZES = "(SELECT p_partkey, CAST(p_size * 37 + 1 AS HUGEINT) AS sw, CAST(p_partkey % 500 + 1 AS HUGEINT) AS sh, CAST(12192000 AS HUGEINT) AS w, CAST(6858000 AS HUGEINT) AS h FROM part)"


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 1).cast("long").alias("sw"), (F.col("p_partkey") % 500 + 1).alias("sh"), F.lit(12_192_000).alias("w"), F.lit(6_858_000).alias("h"))


@query(
    f"""SELECT p_partkey, CAST((12192000 - fw) // 2 AS BIGINT) AS x, CAST((6858000 - fh) // 2 AS BIGINT) AS y, CAST(fw AS BIGINT) AS width, CAST(fh AS BIGINT) AS height FROM (SELECT p_partkey, CASE WHEN sw * h > w * sh THEN w ELSE greatest(1, h * sw // sh) END AS fw, CASE WHEN sw * h > w * sh THEN greatest(1, w * sh // sw) ELSE h END AS fh FROM {_SIZES})"""
)
def media_contain(spark: SparkSession, d: str) -> DataFrame:
    frame = geometry.contain(*map(F.col, ("sw", "sh", "w", "h")))
    return _pictures(spark, d).select("p_partkey", frame.alias("f")).select("p_partkey", "f.x", "f.y", F.col("f.w").alias("width"), F.col("f.h").alias("height"))


@query(
    f"""SELECT p_partkey, CAST(CASE WHEN a > b THEN least(49999, ((a - b) * 100000 + a) // (2 * a)) ELSE 0 END AS BIGINT) AS horizontal, CAST(CASE WHEN b > a THEN least(49999, ((b - a) * 100000 + b) // (2 * b)) ELSE 0 END AS BIGINT) AS vertical FROM (SELECT p_partkey, sw * h AS a, sh * w AS b FROM {_SIZES})"""
)
def media_cover(spark: SparkSession, d: str) -> DataFrame:
    crop = geometry.cover_crop(*map(F.col, ("sw", "sh", "w", "h")))
    return _pictures(spark, d).select("p_partkey", crop.alias("c")).select("p_partkey", "c.horizontal", "c.vertical")


@query("SELECT p_partkey, (p_size * 100 * 12700 // 100) * 6 // 5 AS line, CAST((10 * (100 - p_size) + 200 * p_size + 50) // 100 AS BIGINT) AS channel FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def font_metrics(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    return table(spark, d, "part").select("p_partkey", geometry.line_height(size * 100).alias("line"), geometry.mix_channel(F.lit(10), F.lit(200), size).alias("channel"))


@query("SELECT page_id, sha256(html) AS sha, substr(sha256('page' || chr(10) || length(url) || ':' || url), 1, 32) AS id FROM pages")
def source_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha"), revisions.stable_id("page", F.col("url")).alias("id"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM events, (VALUES ('k'), ('page')) AS v(k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON column as rows."""
    pairs = F.array(*(F.struct(F.lit(k).alias("name"), F.get_json_object("props", f"$.{k}").alias("value")) for k in ("k", "page")))
    return table(spark, d, "events").select("event_id", F.explode(pairs).alias("p")).filter("p.value is not null").select("event_id", "p.value", "p.name")
