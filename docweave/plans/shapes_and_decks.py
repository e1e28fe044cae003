"""Queries on names, roles, colours, matrices, placeholders, groups and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import decks
from ..registry import query, table


def _pick(values: list, n: Column) -> Column:
    """values[n modulo their number]."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


def _sql_pick(values: list, n: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"][CAST(({n}) % {len(values)} + 1 AS INTEGER)]"


_URIS = ["urn:a", "urn:p", "urn:strict"]


@query(
    """SELECT p_partkey, CASE WHEN k = 0 THEN 'urn:a' WHEN k = 1 THEN 'urn:p' WHEN k = 3 AND p_partkey % 2 = 0 THEN 'urn:default' END AS namespace, CASE k WHEN 0 THEN 'sp' WHEN 1 THEN 'pic:x' WHEN 2 THEN 'odd' ELSE 'title' END AS local,
    CASE WHEN k = 2 THEN 'UNDECLARED_PREFIX' END AS code, k = 1 AS known FROM (SELECT p_partkey, p_size % 4 AS k FROM part)"""
)
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Prefixed and plain names of elements (even keys) and attributes; which of them lie in namespaces that are known."""
    scope = F.create_map(*(F.lit(x) for x in ("a", "urn:a", "p", "urn:p", "", "urn:default")))
    found = shapes.resolved_name(_pick(["a:sp", "p:pic:x", "q:odd", "title"], F.col("p_size")), scope, F.col("p_partkey") % 2 == 0)
    out = table(spark, d, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.*")
    return out.withColumn("known", F.coalesce(F.col("namespace").isin("urn:p", "urn:strict"), F.lit(False)))


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'Image' WHEN 2 THEN 'Chart' END AS kind, CASE WHEN p_size % 5 < 3 THEN 'id-' || p_partkey END AS id FROM part"""
)
def metadata_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Bindings that descriptions declare; other kinds and bad ids declare none."""
    key = F.col("p_partkey").cast("string")
    description = F.concat(_pick(["deck:text:id-", "deck:image:id-", "deck:chart:id-", "deck:video:id-", "deck:text:no id "], F.col("p_size")), key)
    return table(spark, d, "part").select("p_partkey", shapes.metadata_binding(description, "deck").alias("b")).select("p_partkey", "b.kind", "b.id")


_NAMES = ["[Content_Types].xml", "ppt/_rels/presentation.xml.rels", "x/presentation.xml", "ppt/presentation.xml", "presentation.xml", "ppt/slides/slide1.xml", "ppt/slides/_rels/slide1.xml.rels", "ppt/notesSlides/n1.xml"]


@query(f"SELECT p_partkey, name, p_size % 8 IN (0, 1, 2, 3, 6) AS bears_topology FROM (SELECT p_partkey, p_size, {_sql_pick(_NAMES, 'p_size')} AS name FROM part)")
def graph_identity(spark: SparkSession, d: str) -> DataFrame:
    """Parts that decide what the package's graph looks like."""
    named = table(spark, d, "part").select("p_partkey", _pick(_NAMES, F.col("p_size")).alias("name"))
    return named.withColumn("bears_topology", shapes.bears_topology(F.col("name")))


@query(
    """SELECT o_orderkey, 'ppt/' || folder || '/' || o_orderkey || '.xml' AS name FROM (SELECT *, ['slides', 'notesSlides', 'media', 'slides/_rels'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS folder FROM orders)
    WHERE o_orderkey % 4 = 2 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)"""
)
def removal_filter(spark: SparkSession, d: str) -> DataFrame:
    """Slides and notes go unless they are made anew; other parts stay."""
    key = F.col("o_orderkey").cast("string")
    parts = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("ppt/"), _pick(["slides", "notesSlides", "media", "slides/_rels"], F.col("o_orderkey")), F.lit("/"), key, F.lit(".xml")).alias("name"))
    anew = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey").distinct().withColumn("anew", F.lit(True))
    joined = parts.join(anew, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.filter(~shapes.regenerated_folder(F.col("name")) | F.col("anew")).select("o_orderkey", "name")


_ROLES = ["List", "Table", "Chart", "Code", "Diagram", "DisplayMath", "Gallery", "Quote", "Definition", "Figure", "TableRow", "Prose", "Section"]
_CONTENTS = ["List", "Table", "Chart", "Code", "Svg", "Children", "Image", "Text"]


@query(
    f"""SELECT p_partkey, role, content, CASE WHEN role IN ('List', 'Table', 'Chart', 'Code') THEN content = role WHEN role IN ('Diagram', 'DisplayMath') THEN content = 'Svg' WHEN role IN ('Gallery', 'Quote', 'Definition') THEN content = 'Children'
    WHEN role = 'Figure' THEN content IN ('Image', 'Children') WHEN role = 'TableRow' THEN false ELSE content IN ('Text', 'Children') END AS allowed
    FROM (SELECT p_partkey, {_sql_pick(_ROLES, 'p_partkey')} AS role, {_sql_pick(_CONTENTS, 'p_size')} AS content FROM part)"""
)
def role_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a node's role may hold its content."""
    nodes = table(spark, d, "part").select("p_partkey", _pick(_ROLES, F.col("p_partkey")).alias("role"), _pick(_CONTENTS, F.col("p_size")).alias("content"))
    return nodes.withColumn("allowed", shapes.role_allows(F.col("role"), F.col("content")))


_KINDS = ["Stack", "TableWide", "FlowColumns", "WeightedSplit", "MediaStart", "MediaEnd", "Comparison", "PeerGrid", "Gallery", "LeadSupporting", "Other"]


@query(
    f"""SELECT p_partkey, kind, slots, CASE WHEN kind IN ('Stack', 'TableWide') THEN slots = 1 WHEN kind = 'FlowColumns' THEN slots BETWEEN 2 AND 3 WHEN kind IN ('PeerGrid', 'Gallery') THEN slots BETWEEN 2 AND 6 WHEN kind = 'LeadSupporting' THEN slots = 3 WHEN kind = 'Other' THEN false ELSE slots = 2 END AS valid
    FROM (SELECT p_partkey, {_sql_pick(_KINDS, 'p_partkey')} AS kind, p_size % 8 AS slots FROM part)"""
)
def topology_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether a layout's number of slots is legal."""
    pages = table(spark, d, "part").select("p_partkey", _pick(_KINDS, F.col("p_partkey")).alias("kind"), (F.col("p_size") % 8).alias("slots"))
    return pages.withColumn("valid", shapes.topology_valid(F.col("kind"), F.col("slots")))


_LINKS = ["https://a.b", "http://a.b", "mailto:a@b", "tel:1", "ftp://a", None]
_FILLS = ["00ff7F", "xyzxyz", "12345", None, "1234567"]


@query(
    f"""SELECT p_partkey, CASE WHEN p_size * 300 > 10000 THEN 'COPIES' WHEN p_partkey % 500 * 100 > 40000 OR p_partkey % 500 * 100 < 100 THEN 'FONT_SIZE' WHEN p_partkey % 9 = 0 THEN 'RUN_COLOR' WHEN p_partkey % 5 IN (1, 2, 4) THEN 'FILL_COLOR' WHEN p_partkey % 6 = 4 THEN 'LINK' ELSE 'ok' END AS verdict FROM part"""
)
def shape_validation(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that a shape's data break."""
    key = F.col("p_partkey")
    run = F.struct((key % 500 * 100).alias("font_size"), F.when(key % 9 == 0, "12 456").otherwise(F.lit(None)).alias("color"))
    verdict = shapes.shape_verdict(F.col("p_size") * 300, F.array(run), _pick(_FILLS, key), _pick(_LINKS, key))
    return table(spark, d, "part").select("p_partkey", verdict.alias("verdict"))


@query(
    """SELECT 'Master' AS level, n_nationkey AS key, n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal FROM nation WHERE n_regionkey <> 2
    UNION ALL SELECT 'Layout', s_suppkey, s_name, (SELECT count(*) FROM nation WHERE n_regionkey <> 2) + row_number() OVER (ORDER BY s_suppkey) - 1 FROM supplier WHERE s_nationkey % 3 <> 0"""
)
def free_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of master and layout that are no placeholders, in drawing order."""
    master = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 2, "body").alias("placeholder"))
    layout = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 3 == 0, "body").alias("placeholder"))
    free = lambda df: df.filter("placeholder is null").drop("placeholder")
    return decks.layered([("Master", free(master)), ("Layout", free(layout))], ["key"]).select("level", "key", "name", "ordinal")


_TOKENS = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, CASE (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS depth FROM orders"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as tokens of a document, nested in turns."""
    from ..operators.tables import numbered

    rows = numbered(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    return rows.select("o_custkey", F.col("row_no").cast("long").alias("seq"), _pick([0, 1, 2, 2, 1], F.col("row_no") - 1).alias("depth"))


@query(f"WITH t AS ({_TOKENS}) SELECT o_custkey, seq, CAST(depth AS INTEGER) AS depth, (SELECT max(b.seq) FROM t b WHERE b.o_custkey = a.o_custkey AND b.seq < a.seq AND b.depth = a.depth - 1) AS parent FROM t a")
def element_tree(spark: SparkSession, d: str) -> DataFrame:
    """The parent of each token."""
    return decks.element_parents(_tokens(spark, d), ["o_custkey"])


@query(f"""WITH t AS ({_TOKENS}) SELECT t.o_custkey, t.seq, s AS plot FROM t, (SELECT 1 AS s, 12 AS e UNION ALL SELECT 13, 40) r WHERE t.seq > s AND t.seq < e AND t.depth = 1""")
def series_to_plot(spark: SparkSession, d: str) -> DataFrame:
    """Tokens one level below the plot whose range they lie in."""
    plots = _tokens(spark, d).select("o_custkey").distinct().select("o_custkey", F.explode(F.array(F.struct(F.lit(1).alias("start"), F.lit(12).alias("end")), F.struct(F.lit(13).alias("start"), F.lit(40).alias("end")))).alias("r"))
    ranges = plots.select("o_custkey", "r.start", "r.end", F.lit(0).alias("depth"), F.col("r.start").alias("plot"))
    return decks.inside_at_depth(ranges, _tokens(spark, d), ["o_custkey"]).select("o_custkey", "seq", "plot")


@query(
    """SELECT c_custkey, (SELECT min(n_nationkey) FROM nation n WHERE n.n_nationkey % 10 = c.idx OR (n.n_regionkey = c.kind AND (n.n_nationkey % 10 = 0 OR c.idx = 0))) AS ord FROM (SELECT c_custkey, c_custkey % 12 AS idx, c_nationkey % 7 AS kind FROM customer) c"""
)
def placeholder_match(spark: SparkSession, d: str) -> DataFrame:
    """The first layout placeholder of the same index, or of the same kind where either index is 0."""
    expected = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 12).cast("int").alias("idx"), (F.col("c_nationkey") % 7).alias("kind"))
    candidates = table(spark, d, "nation").select((F.col("n_nationkey") % 10).alias("idx"), F.col("n_regionkey").alias("kind"), F.col("n_nationkey").alias("ord"))
    return decks.matched_placeholders(expected, candidates, "c_custkey")


_UNITS = ["Figure", "Caption", "Quote", "Credit", "Section", "Prose", "Prose"]


@query(
    f"""WITH u AS (SELECT conv_id, turn, {_sql_pick(_UNITS, 'conv_id + turn * 3')} AS role FROM conversations),
    r AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM u),
    p AS (SELECT conv_id, turn, role, coalesce((role = 'Figure' AND following = 'Caption') OR (role = 'Quote' AND following = 'Credit') OR (role = 'Section' AND following IS NOT NULL), false) AS related FROM r),
    s AS (SELECT *, coalesce(lag(related) OVER (PARTITION BY conv_id ORDER BY turn), false) AS tied FROM p)
    SELECT conv_id, turn, role, related, max(CASE WHEN NOT tied THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM s"""
)
def adjacent_groups(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours that belong together, by all three rules, and the runs they tie."""
    units = table(spark, d, "conversations").select("conv_id", "turn", _pick(_UNITS, F.col("conv_id") + F.col("turn") * 3).alias("role"))
    return decks.chained_groups(decks.adjacent_pairs(units, ["conv_id"], "turn", "role"), ["conv_id"], "turn").select("conv_id", "turn", "role", "related", "chain")


@query("SELECT conv_id, turn, CASE WHEN turn BETWEEN 1 AND 3 AND (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = 1) > 0 THEN conv_id * 100 + 1 ELSE conv_id * 100 + turn END AS grp FROM conversations a")
def caption_groups(spark: SparkSession, d: str) -> DataFrame:
    """A picture and its caption, and all between them, become one group."""
    units = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("grp"))
    spans = units.select("conv_id").distinct().select("conv_id", F.lit(1).alias("start"), F.lit(3).alias("end"))
    return decks.spanned_groups(units, spans, ["conv_id"], "turn", "grp").select("conv_id", "turn", "grp")


@query(
    """WITH p AS (SELECT *, (o_orderkey - 1) // 1 AS z FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)),
    g AS (SELECT o_custkey, (rn - 1) // 4 AS page, list(o_orderkey ORDER BY rn) AS cells, max(rn) AS last FROM p GROUP BY 1, 2)
    SELECT c_custkey, c_name AS heading, CAST(coalesce(page, 0) AS INTEGER) AS page, CAST(coalesce((SELECT max(page) + 1 FROM g x WHERE x.o_custkey = c_custkey), 1) AS INTEGER) AS pages, coalesce(array_to_string(cells, ','), '') AS cells
    FROM customer LEFT JOIN g ON c_custkey = o_custkey"""
)
def table_pages(spark: SparkSession, d: str) -> DataFrame:
    """Tables of all customers in pages of four orders, each under its heading; a customer without orders has one empty page."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    heads = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("heading"))
    paged = decks.table_pages(heads, rows, ["c_custkey"], ["o_orderkey"], 4, F.col("o_orderkey").cast("string"))
    return paged.select("c_custkey", "heading", "page", "pages", F.array_join("cells", ",").alias("cells"))


_MERGE = "(SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0) b FULL JOIN (SELECT c_custkey + 3 AS k, 'N' || c_nationkey AS v FROM customer WHERE c_custkey % 7 = 0) n ON b.k = n.k"


def _merge(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer")
    base = customers.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    delta = customers.filter("c_custkey % 7 = 0").select((F.col("c_custkey") + 3).alias("k"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("v"))
    return decks.merged(base, delta, ["k"], "v")


@query(f"SELECT coalesce(b.k, n.k) AS k, coalesce(n.v, b.v) AS v, b.v AS previous, b.k IS NOT NULL AS had, n.k IS NOT NULL AS touched FROM {_MERGE}")
def map_merge(spark: SparkSession, d: str) -> DataFrame:
    """A delta's keys replace, others stay; what was there before is kept for undoing."""
    return _merge(spark, d)


@query("SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 5 <> 0")
def map_undo(spark: SparkSession, d: str) -> DataFrame:
    """A merge undone is the base."""
    return decks.undone(_merge(spark, d), ["k"], "v")


_SIDES = "a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F')"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    side = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    return decks.zipped(side("O"), side("F"), ["o_custkey"], "o_orderkey")


@query(f"WITH {_SIDES} SELECT a.o_custkey, CAST(a.pos AS INTEGER) AS pos, a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.pos = b.pos WHERE a.n = b.n")
def strict_zip(spark: SparkSession, d: str) -> DataFrame:
    """Series and values paired by place, where their counts agree."""
    return _sides(spark, d)[0]


@query(f"WITH {_SIDES}, x AS (SELECT o_custkey, max(n) AS n FROM a GROUP BY 1), y AS (SELECT o_custkey, max(n) AS n FROM b GROUP BY 1) SELECT coalesce(x.o_custkey, y.o_custkey) AS o_custkey, coalesce(x.n, 0) AS left_rows, coalesce(y.n, 0) AS right_rows, 'COUNT_MISMATCH' AS code FROM x FULL JOIN y ON x.o_custkey = y.o_custkey WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)")
def zip_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Groups that are not paired, for their counts differ."""
    return _sides(spark, d)[1]


_FRAMES = "(SELECT o_orderkey, o_orderkey % 900 AS mx, o_custkey % 700 AS my, o_custkey % 800 AS tx, o_orderkey % 600 AS ty, o_orderkey % 90 + 10 AS mw, o_custkey % 70 + 10 AS tw, o_orderkey % 2 = 0 AS before, o_orderkey % 5 = 0 AS caption, ['SameParagraph', 'AdjacentBlocks', 'BlankSeparatedBlocks'][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS proximity FROM orders)"


@query(
    f"""SELECT o_orderkey, ((dx + dy) * 1000 // 1600 + CASE WHEN (CASE WHEN abs(cmx - ctx) >= abs(cmy - cty) THEN ctx <= cmx ELSE cty <= cmy END) = before THEN 0 ELSE 250 END) * CASE WHEN caption THEN 8 WHEN proximity = 'SameParagraph' THEN 4 WHEN proximity = 'AdjacentBlocks' THEN 2 ELSE 1 END AS loss
    FROM (SELECT *, abs(cmx - ctx) AS dx, abs(cmy - cty) AS dy FROM (SELECT *, mx + mw // 2 AS cmx, my + mw // 2 AS cmy, tx + tw // 2 AS ctx, ty + tw // 2 AS cty FROM {_FRAMES}))"""
)
def relation_losses(spark: SparkSession, d: str) -> DataFrame:
    """Distance, wrong side and strength of the tie between pictures and their texts on a page of 1000 by 600."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    frame = lambda x, y, size: F.struct(x.alias("x"), y.alias("y"), size.alias("width"), size.alias("height"))
    media, text = frame(key % 900, other % 700, key % 90 + 10), frame(other % 800, key % 600, other % 70 + 10)
    loss = decks.relation_loss(media, text, key % 2 == 0, key % 5 == 0, _pick(["SameParagraph", "AdjacentBlocks", "BlankSeparatedBlocks"], key), (1000, 600))
    return table(spark, d, "orders").select("o_orderkey", loss.alias("loss"))


@query(
    """SELECT p_partkey, CAST((CASE WHEN iw * fh > fw * ih THEN iw * fh - fw * ih ELSE fw * ih - iw * fh END) * 1000 // greatest(1, iw * fh, fw * ih) AS BIGINT) AS crop, CAST((fw * fh - greatest(1, least(fw, iw)) * greatest(1, least(fh, ih))) * 1000 // (fw * fh) AS BIGINT) AS unused
    FROM (SELECT p_partkey, CAST(p_size * 1000 AS HUGEINT) AS iw, CAST(p_partkey * 7 AS HUGEINT) AS ih, CAST(12192000 AS HUGEINT) AS fw, CAST(p_partkey % 97 * 1000 + 1 AS HUGEINT) AS fh FROM part)"""
)
def area_penalties(spark: SparkSession, d: str) -> DataFrame:
    """What a covering picture loses and a contained one leaves empty, in thousandths."""
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    image, frame = (size * 1000, key * 7), (F.lit(12_192_000).cast("long"), key % 97 * 1000 + 1)
    seen = tuple(F.least(a, b) for a, b in zip(image, frame))
    return table(spark, d, "part").select("p_partkey", shapes.cover_loss(image, frame).alias("crop"), shapes.unused_share(frame, seen).alias("unused"))


_CODES = ["l", "ctr", "r", "just", "justLow", "dist", "thaiDist", "t", "b", "arrow", "oval", "none"]


@query(
    f"""SELECT p_partkey, code, CASE WHEN code = 'l' THEN 'Left' WHEN code = 'ctr' THEN 'Center' WHEN code = 'r' THEN 'Right' WHEN code LIKE 'just%' THEN 'Justify' WHEN code IN ('dist', 'thaiDist') THEN 'Distributed' END AS horizontal,
    CASE code WHEN 't' THEN 'Top' WHEN 'ctr' THEN 'Center' WHEN 'b' THEN 'Bottom' END AS vertical, CASE code WHEN 'arrow' THEN 'Arrow' WHEN 'oval' THEN 'Oval' END AS line_end FROM (SELECT p_partkey, {_sql_pick(_CODES, 'p_partkey')} AS code FROM part)"""
)
def alignment_maps(spark: SparkSession, d: str) -> DataFrame:
    """Codes of alignment and line ends by name."""
    coded = table(spark, d, "part").select("p_partkey", _pick(_CODES, F.col("p_partkey")).alias("code"))
    names = {"horizontal": shapes.ALIGNMENTS, "vertical": shapes.VERTICAL_ALIGNMENTS, "line_end": shapes.LINE_ENDS}
    return coded.withColumns({c: shapes.looked_up(m, F.col("code")) for c, m in names.items()})


_MARKUP = "'<a:r><a:rPr' || CASE conv_id % 3 WHEN 0 THEN ' b=\"1\"' WHEN 1 THEN ' b=\"0\"' ELSE '' END || CASE turn % 3 WHEN 0 THEN ' i=\"1\"' WHEN 1 THEN ' i=\"0\"' ELSE '' END || CASE WHEN turn % 2 = 0 THEN ' u=\"sng\"' ELSE ' u=\"none\"' END || CASE WHEN conv_id % 2 = 0 THEN ' sz=\"' || (1000 + turn) || '\"' ELSE '' END || CASE WHEN turn % 4 = 0 THEN '><a:solidFill><a:srgbClr val=\"00FF00\"/></a:solidFill></a:rPr>' ELSE '/>' END || '<a:t>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</a:t></a:r>'"


@query(f"SELECT conv_id, string_agg({_MARKUP}, '' ORDER BY turn) AS markup FROM conversations GROUP BY conv_id")
def rich_markup(spark: SparkSession, d: str) -> DataFrame:
    """The runs of a paragraph as markup."""
    conv, turn = F.col("conv_id"), F.col("turn")
    third = lambda c: F.when(c % 3 == 0, True).when(c % 3 == 1, False)
    run = F.struct(
        F.col("text").alias("text"),
        third(conv).alias("bold"),
        third(turn).alias("italic"),
        (turn % 2 == 0).alias("underline"),
        F.when(conv % 2 == 0, 1000 + turn).alias("font_size"),
        F.when(turn % 4 == 0, "00FF00").alias("color"),
    )
    runs = table(spark, d, "conversations").select("conv_id", "turn", shapes.run_markup(run).alias("m"))
    return runs.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda r: r["m"]), "").alias("markup"))


@query(
    """WITH r AS (SELECT conv_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, length(text) AS len FROM conversations),
    s AS (SELECT conv_id, total, unnest(range(0, CAST((total + 199) // 200 AS BIGINT))) AS slice FROM (SELECT conv_id, max(e) AS total FROM r GROUP BY 1))
    SELECT conv_id, slice, turn, substr(text, CAST(greatest(slice * 200, e - len) - (e - len) + 1 AS BIGINT), CAST(least(slice * 200 + 200, e) - greatest(slice * 200, e - len) AS BIGINT)) AS part FROM s JOIN r USING (conv_id) WHERE slice * 200 < e AND e - len < slice * 200 + 200 AND len > 0"""
)
def rich_slices(spark: SparkSession, d: str) -> DataFrame:
    """Slices of 200 signs of a paragraph, each as the runs it reaches over."""
    from ..operators import joins, windows

    runs = windows.running_offsets(table(spark, d, "conversations").select("conv_id", "turn", "text", F.char_length("text").cast("long").alias("len")), ["conv_id"], ["turn"], "len")
    runs = runs.select("conv_id", "turn", "text", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    totals = runs.groupBy("conv_id").agg(F.max("r_end").alias("total")).filter("total > 0")
    slices = totals.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 200))).alias("slice"))
    slices = slices.select("conv_id", "slice", (F.col("slice") * 200).alias("t_start"), (F.col("slice") * 200 + 200).alias("t_end"))
    met = joins.spans_meeting(slices, runs, ["conv_id"])
    part = F.substring("text", (F.col("start") - F.col("r_start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return met.select("conv_id", "slice", "turn", part.alias("part"))


@query(
    """SELECT c_custkey, lpad(lower(to_hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(c_name) + 1), lambda i: CAST(ord(substr(c_name, i, 1)) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT))), 16, '0') AS signature FROM customer"""
)
def structural_signature(spark: SparkSession, d: str) -> DataFrame:
    """FNV-1a of each name's bytes."""
    return table(spark, d, "customer").select("c_custkey", shapes.structural_signature(F.col("c_name")).alias("signature"))


@query(
    """SELECT l_orderkey, m.e AS x, m.f AS y FROM (SELECT l_orderkey, list_reduce(list({a: CAST(1 + l_linenumber % 2 AS DOUBLE), b: 0.0::DOUBLE, c: CAST(l_linenumber % 3 AS DOUBLE), d: CAST(1 AS DOUBLE), e: CAST(l_partkey % 10 AS DOUBLE), f: CAST(l_suppkey % 10 AS DOUBLE)} ORDER BY l_linenumber, l_partkey, l_suppkey),
    lambda l, r: {a: l.a * r.a + l.c * r.b, b: l.b * r.a + l.d * r.b, c: l.a * r.c + l.c * r.d, d: l.b * r.c + l.d * r.d, e: l.a * r.e + l.c * r.f + l.e, f: l.b * r.e + l.d * r.f + l.f}) AS m FROM lineitem GROUP BY l_orderkey)"""
)
def matrix_chain(spark: SparkSession, d: str) -> DataFrame:
    """Where nested groups move the origin to: their matrices, outermost first, as one."""
    n = F.col("l_linenumber")
    own = shapes.matrix(1 + n % 2, F.lit(0), n % 3, F.lit(1), F.col("l_partkey") % 10, F.col("l_suppkey") % 10)
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", own.alias("m")))).alias("l"))
    at = shapes.moved_point(shapes.composed(F.transform("l", lambda x: x["m"])), F.lit(0.0), F.lit(0.0))
    return rows.select("l_orderkey", at.alias("p")).select("l_orderkey", "p.x", "p.y")


_PARTKEY = "(SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_size * 5 % 256 AS b, 255 AS a, p_size * 2000 AS v FROM part)"


@query(
    f"""SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN r + (255 - r) * v // 100000 WHEN 1 THEN r * v // 100000 WHEN 2 THEN 255 - r WHEN 3 THEN (r * 21 + g * 72 + b * 7) // 100 WHEN 4 THEN least(255, r + 255 * v // 100000) ELSE r END AS INTEGER) AS red,
    CAST(CASE p_partkey % 6 WHEN 0 THEN g + (255 - g) * v // 100000 WHEN 1 THEN g * v // 100000 WHEN 2 THEN 255 - g WHEN 3 THEN (r * 21 + g * 72 + b * 7) // 100 ELSE g END AS INTEGER) AS green,
    CAST(CASE p_partkey % 6 WHEN 0 THEN b + (255 - b) * v // 100000 WHEN 1 THEN b * v // 100000 WHEN 2 THEN 255 - b WHEN 3 THEN (r * 21 + g * 72 + b * 7) // 100 ELSE b END AS INTEGER) AS blue,
    CAST(CASE WHEN p_partkey % 6 = 5 THEN (255 * 50000 // 100000) * v // 100000 ELSE 255 * 50000 // 100000 END AS INTEGER) AS alpha FROM {_PARTKEY}"""
)
def color_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Colours made half transparent, and then tinted, shaded, inverted, grey, moved or made fainter."""
    key, size = F.col("p_partkey"), F.col("p_size")
    color = F.struct((key % 256).cast("int").alias("red"), (key * 7 % 256).cast("int").alias("green"), (size * 5 % 256).cast("int").alias("blue"), F.lit(255).alias("alpha"))
    then = F.struct(_pick(["tint", "shade", "inv", "gray", "redOff", "alphaMod"], key).alias("kind"), (size * 2000).cast("int").alias("value"))
    half = F.struct(F.lit("alpha").alias("kind"), F.lit(50_000).alias("value"))
    return table(spark, d, "part").select("p_partkey", shapes.transformed_color(color, F.array(half, then)).alias("c")).select("p_partkey", "c.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size * 11 END AS width, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(p_partkey % 60000 AS INTEGER) END AS height FROM part")
def image_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes read from picture headers; unknown formats give none."""
    width, height = (F.col("p_size") * 11).cast("int"), (F.col("p_partkey") % 60_000).cast("int")
    big = lambda n: F.lpad(F.hex(n), 8, "0")
    small = lambda n: F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width), big(height))
    gif = F.concat(F.lit("474946383961"), small(width), small(height))
    content = F.unhex(F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, gif).otherwise(F.lit("FFD8FF")))
    return table(spark, d, "part").select("p_partkey", shapes.image_size(content).alias("s")).select("p_partkey", "s.width", "s.height")


@query("SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id % 50 ORDER BY encode(url), page_id) AS INTEGER) AS place FROM pages")
def byte_order(spark: SparkSession, d: str) -> DataFrame:
    """Names of a package in the order of their UTF-8 bytes."""
    from pyspark.sql import Window

    order = Window.partitionBy(F.col("page_id") % 50).orderBy(F.encode("url", "utf-8"), "page_id")
    return table(spark, d, "pages").select("page_id", F.row_number().over(order).alias("place"))
