"""Operators on small tables whose results are known."""

import colorsys
import io
import itertools
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.functions import geometry, shapes, slices, text, wrapping
from docweave.operators import decks, graph, joins, pagination, patches, revisions, tables, windows
from docweave.sources import packages
from docweave.streaming import sessions


def one(df):
    return [tuple(r) for r in df.collect()]


def test_row_policies(spark):
    rows = spark.createDataFrame([("t", i, 10) for i in range(3)], "t string, i int, h int")
    assert one(tables.overflowing(rows, ["t"], 2).select("t", "n_rows", "code")) == [("t", 3, "INVALID_TABLE")]
    assert [r[1] for r in one(tables.clipped(rows, ["t"], ["i"], 2).orderBy("i"))] == [0, 1]
    assert {r.height for r in tables.shrunk(rows, ["t"], F.col("h"), 2).collect()} == {7}
    assert [(r.page, r.pages) for r in tables.continued(rows, ["t"], ["i"], 2).orderBy("i").collect()] == [(0, 2), (0, 2), (1, 2)]
    with pytest.raises(ValueError):
        tables.clipped(rows, ["t"], ["i"], 0)


def test_graph_with_cycle_and_orphan(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "source string, target string")
    roots = spark.createDataFrame([("a",)], "node string")
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    assert sorted(one(graph.reachable(edges, roots))) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(one(graph.orphans(nodes, edges, roots))) == [("x",), ("y",)]
    assert sorted(one(graph.on_cycles(edges))) == [("b",), ("c",)]
    assert sorted(one(graph.affected(edges, spark.createDataFrame([("y",)], "node string")))) == [("x", 1), ("y", 0)]


def test_revisions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    assert sorted(one(revisions.diff(old, new, ["k"], ["v"]))) == [(1, "removed"), (2, "changed"), (4, "added")]
    merged = revisions.overlay(old, spark.createDataFrame([(2, "z")], "k int, v string"), spark.createDataFrame([(1,)], "k int"), ["k"])
    assert sorted(one(merged), key=repr) == [(2, "z", True), (3, None, False)]


def test_content_type_last_key_wins(spark):
    parts = spark.createDataFrame([("a/b.XML",), ("c",), ("d.png",)], "name string")
    over = spark.createDataFrame([("/d.png", "one", 0), ("d.png", "two", 1)], "name string, content_type string, ord int")
    base = spark.createDataFrame([("xml", "text", 0)], "extension string, content_type string, ord int")
    got = {r.name: (r.content_type, r.source) for r in joins.content_types(parts, over, base).collect()}
    assert got == {"a/b.XML": ("text", "Default"), "c": (None, "Missing"), "d.png": ("two", "Override")}


def test_auto_numbers_restart_below(spark):
    rows = [(i, lvl, num, 1) for i, (lvl, num) in enumerate([(0, True), (1, True), (1, True), (0, False), (1, True), (0, True), (1, True)])]
    df = spark.createDataFrame([("f", *r) for r in rows], "f string, i int, lvl int, num boolean, st int")
    got = [r.number for r in windows.auto_numbers(df, ["f"], ["i"], "lvl", "num", "st").orderBy("i").collect()]
    assert got == [1, 1, 2, None, 3, 2, 1]


@pytest.mark.parametrize(
    "target, want",
    [("../media/a.png#x", "ppt/media/a.png"), ("/x/y", "x/y"), ("../../../z", None), ("a\\b", None), ("./s.xml", "ppt/slides/s.xml")],
)
def test_resolve_path(spark, target, want):
    row = spark.range(1).select(text.resolve_path(F.lit("ppt/slides/slide1.xml"), F.lit(target)).alias("p")).first()
    assert row.p == want


def test_number_formats(spark):
    rows = spark.createDataFrame([(1,), (4,), (12,), (27,), (49,), (702,), (703,), (3999,)], "n long")
    got = {r.n: tuple(r)[1:] for r in rows.select("n", text.spreadsheet_column(F.col("n")), text.roman(F.col("n")), text.ordinal(F.col("n"))).collect()}
    assert got[1] == ("A", "I", "1st") and got[12] == ("L", "XII", "12th") and got[27][0] == "AA"
    assert got[702][0] == "ZZ" and got[703][0] == "AAA" and got[49][1] == "XLIX" and got[3999][1] == "MMMCMXCIX"


def test_slices_cover_text():
    long = "word " * 400 + "Ende。 ü" * 90 + "x" * 1200
    parts = slices.slices(long)
    assert "".join(long[p["start"] : p["end"]] for p in parts) == long
    assert all(len(long[p["start"] : p["end"]].encode()) <= 512 for p in parts)
    assert slices.slices("") == [] and slices.slices(None) is None


def test_packages_survive_damage(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<a/>")
        z.writestr("b/c.bin", b"\0" * 100)
    whole = out.getvalue()
    df = spark.createDataFrame([("good", whole), ("cut", whole[:40]), ("none", None)], "package_id string, content binary")
    got = sorted((r.package_id, r.name or "", bool(r.intact), bool(r.error)) for r in packages.verified(packages.scan_entries(df)).collect())
    assert got == [("cut", "", False, True), ("good", "a.xml", True, False), ("good", "b/c.bin", True, False), ("none", "", False, True)]


def test_xml_tokens(spark):
    df = spark.createDataFrame([(1, "<a x='1'>é<b/></a>"), (2, "<a>"), (3, "<!DOCTYPE a><a/>"), (4, None)], "k int, x string")
    got = [(r.k, r.kind, r.start, r.end, r.depth) for r in packages.token_rows(df, F.col("x"), ["k"]).orderBy("k", "seq").collect()]
    assert got == [(1, "Start", 0, 9, 1), (1, "Text", 9, 11, 1), (1, "Start", 11, 15, 2), (1, "End", 15, 15, 2), (1, "End", 15, 19, 1)]


def test_pagination_prefers_fewer_then_even_pages(spark):
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate([4, 4, 4, 4, 20])], "deck_id int, ord int, height int")
    assert [r.page for r in pagination.paginate(df, 10).orderBy("ord").collect()] == [0, 0, 1, 1, 2]


def test_live_state():
    state = (0, {}, "")
    seen = []
    for delta in [(0, 1, "a", "1"), (0, 1, "b", "2"), (1, 3, "b", "2"), (1, 2, "a", "3")]:
        state = sessions.advance(state[0], state[1], delta)
        seen.append(state[2])
    assert seen == ["applied", "InvalidRevision", "InvalidRevision", "applied"] and state[:2] == (2, {"a": "3"})


def test_contain_and_cover(spark):
    row = spark.range(1).select(geometry.contain(F.lit(200), F.lit(100), F.lit(100), F.lit(100)).alias("a"), geometry.cover_crop(F.lit(200), F.lit(100), F.lit(100), F.lit(100)).alias("b")).first()
    assert tuple(row.a) == (0, 25, 100, 50) and tuple(row.b) == (25000, 0)


def test_link_kinds(spark):
    df = spark.createDataFrame([(u,) for u in ("http://x", "mailto:a", "tel:1", "#a", "#", " http://x", "javascript:1")], "u string")
    assert [r[0] for r in df.select(text.safe_link(F.col("u"))).collect()] == ["Web", "Email", "Telephone", "Anchor", None, None, None]


def test_slices_stand_before_white_space():
    cut = lambda t: [t[p["start"] : p["end"]] for p in slices.slices(t)]
    assert cut("첫 문장. Second sentence!\n\nLast") == ["첫 문장.", " Second sentence!", "\n", "\nLast"]
    assert cut("a.b c?　d\n\n\ne. ") == ["a.b c?", "　d\n", "\n", "\ne.", " "]
    assert [len(s) for s in cut("x" * 1200)] == [512, 512, 176] and [len(s.encode()) for s in cut("é" * 300)] == [512, 88]
    long = "word " * 150
    assert cut(long)[0] == "word " * 102 and "".join(cut(long)) == long


def all_pages(heights, capacity):
    """Every way to cut a deck: pages, largest demand, squares of unused room."""
    best = None
    for cuts in itertools.product([False, True], repeat=max(0, len(heights) - 1)):
        pages, page = [[heights[0]]], 0
        for h, cut in zip(heights[1:], cuts):
            if cut:
                pages.append([])
            pages[-1].append(h)
        if any(sum(p) > capacity and len(p) > 1 for p in pages):
            continue
        cost = (len(pages), max(map(sum, pages)), sum(max(0, capacity - sum(p)) ** 2 for p in pages))
        best = cost if best is None else min(best, cost)
    return best


def test_pages_of_small_decks(spark):
    rng = random.Random(4)
    decks = {i: [rng.choice([0, 1, 3, 4, 5, 9, 12, 30]) for _ in range(rng.randrange(1, 10))] for i in range(60)}
    rows = [(i, k, h) for i, hs in decks.items() for k, h in enumerate(hs)]
    found = {}
    for r in pagination.paginate(spark.createDataFrame(rows, "deck_id int, ord int, height int"), 12).orderBy("deck_id", "ord").collect():
        found.setdefault(r.deck_id, {}).setdefault(r.page, []).append(max(1, decks[r.deck_id][r.ord]))
    for i, hs in decks.items():
        pages = list(found[i].values())
        cost = (len(pages), max(map(sum, pages)), sum(max(0, 12 - sum(p)) ** 2 for p in pages))
        assert sum(pages, []) == [max(1, h) for h in hs] and cost == all_pages([max(1, h) for h in hs], 12)


def test_many_small_blocks_share_a_page(spark):
    blocks = spark.createDataFrame([(1, i, 1) for i in range(300)], "deck_id int, ord int, height int")
    assert pagination.paginate(blocks, 1000).agg(F.max("page")).first()[0] == 0


def test_refused_deltas_are_undone():
    valid = lambda key, value: value != "bad"
    state = (0, {})
    for delta, status, data in (
        ((0, 1, "a", "x"), "applied", {"a": "x"}),
        ((1, 2, "a", "bad"), "InvalidValue", {"a": "x"}),
        ((1, 2, "b", "bad"), "InvalidValue", {"a": "x"}),
        ((0, 1, "a", "y"), "InvalidRevision", {"a": "x"}),
        ((1, 3, "a", "y"), "InvalidRevision", {"a": "x"}),
        ((1, 2, "a", "y"), "applied", {"a": "y"}),
    ):
        *state, found = sessions.advance(*state, delta, valid)
        assert found == status and state[1] == data
    assert state[0] == 2


def test_geometry_at_slide_sizes(spark):
    rows = [(9007199254740993, 1, 12192000, 6858000), (1920, 1080, 12192000, 6858000), (4000, 3000, 12192000, 6858000), (1, 5, 1, 1)]
    c = [F.col(x) for x in ("sw", "sh", "w", "h")]
    for kind in ("long", "int"):
        df = spark.createDataFrame(rows[kind == "int" :], ", ".join(f"{x} {kind}" for x in ("sw", "sh", "w", "h")))
        for r in df.select("*", geometry.whole(c[0], c[1]).alias("q"), geometry.contain(*c).alias("f"), geometry.cover_crop(*c).alias("k")).collect():
            a, b = r.sw * r.h, r.sh * r.w
            w, h = (r.w, max(1, r.w * r.sh // r.sw)) if a > b else (max(1, r.h * r.sw // r.sh), r.h)
            side = lambda lost, total: min(49_999, (lost * 100_000 + total) // (2 * total))
            assert r.q == r.sw // r.sh and tuple(r.f) == ((r.w - w) // 2, (r.h - h) // 2, w, h)
            assert tuple(r.k) == (side(a - b, a) if a > b else 0, side(b - a, b) if b > a else 0)


@pytest.mark.parametrize(
    "raw, text_, code",
    [
        ("a&amp;b&#65;&#x1F642;c", "a&bA🙂c", None),
        ("&amp;lt;", "&lt;", None),
        ("", "", None),
        ("x", "x", None),
        ("&#+65;", "A", None),
        ("&", None, "UNTERMINATED"),
        ("&amp;&lt", None, "UNTERMINATED"),
        ("&a&amp;", None, "UNSUPPORTED"),
        ("&#6&amp;", None, "INVALID_NUMERIC"),
        ("&nbsp;&#xD800;", None, "UNSUPPORTED"),
        ("&#xD800;&nbsp;", None, "INVALID_NUMERIC"),
        ("&#;", None, "INVALID_NUMERIC"),
        ("&#1114112;", None, "INVALID_NUMERIC"),
        ("&#99999999999999999999;", None, "INVALID_NUMERIC"),
    ],
)
def test_entities(spark, raw, text_, code):
    assert tuple(spark.range(1).select(text.decode_entities(F.lit(raw)).alias("d")).first().d) == (text_, code)


def test_colors(spark):
    def hsl(kind, value, rgb):
        h, l, s = colorsys.rgb_to_hls(*(v / 255 for v in rgb))
        part = value / 100_000
        h, s, l = {"lumMod": (h, s, l * part), "lumOff": (h, s, l + part), "satMod": (h, s * part, l), "satOff": (h, s + part, l), "hueMod": (h * part, s, l), "hueOff": (h + value / 60_000 / 360, s, l)}[kind]
        clamp = lambda v: min(max(v, 0), 1)
        return tuple(math.floor(v * 255 + 0.5) for v in colorsys.hls_to_rgb(h % 1, clamp(l), clamp(s)))

    rng = random.Random(1)
    cases = [(kind, value, tuple(rng.choice([0, 17, 100, 255]) for _ in range(3))) for kind in ("lumMod", "lumOff", "satMod", "satOff", "hueMod", "hueOff") for value in (0, 40_000, 75_000, 120_000, -20_000)]
    rows = [(i, *rgb, kind, value) for i, (kind, value, rgb) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, r int, g int, b int, kind string, value int")
    color = F.struct(F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue"), F.lit(9).alias("alpha"))
    for r in df.select("i", shapes.transformed_color(color, F.array(F.struct("kind", "value"))).alias("c")).collect():
        want = hsl(*cases[r.i])
        assert r.c.alpha == 9 and all(abs(x - y) <= 1 for x, y in zip(r.c[:3], want)), (cases[r.i], r.c, want)


def test_group_matrix(spark):
    child = tuple(F.lit(v) for v in (10.0, 20.0, 50.0, 100.0))
    frame = tuple(F.lit(v) for v in (100.0, 200.0, 100.0, 100.0))
    at = lambda fx, fy, turn: spark.range(1).select(shapes.moved_point(shapes.group_matrix(*frame, child, F.lit(fx), F.lit(fy), F.lit(turn)), F.lit(10.0), F.lit(20.0)).alias("p")).first().p
    close = lambda p, q: all(abs(a - b) < 1e-9 for a, b in zip(p, q))
    assert close(at(False, False, 0), (100, 200)) and close(at(True, False, 0), (200, 200)) and close(at(True, True, 0), (200, 300))
    assert close(at(False, False, 90 * 60_000), (200, 200)) and close(at(False, False, 180 * 60_000), (200, 300))


def test_pictures_in_running_text(spark):
    child = "array<struct<role:string,content:string>>"
    rows = [("Prose", "Prose", "Children", [("Prose", "Text"), ("Prose", "Svg")], True), ("Prose", "Prose", "Children", [("Prose", "Svg")], False), ("Prose", "Section", "Children", [("Prose", "Text"), ("Prose", "Svg")], False), ("Prose", None, None, None, False), ("Prose", "Prose", "Children", [("Prose", "Text"), ("Prose", "Svg"), ("Quote", "Text")], False)]
    df = spark.createDataFrame(rows, f"role string, parent string, content string, siblings {child}, want boolean")
    got = df.select("want", shapes.inline_picture_allowed(F.col("role"), F.col("parent"), F.col("content"), F.col("siblings")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_empty_tables_have_a_page(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "b")], "t int, head string")
    rows = spark.createDataFrame([(1, i, f"c{i}") for i in range(3)], "t int, i int, c string")
    got = sorted((r.t, r.head, r.page, r.pages, list(r.cells)) for r in decks.table_pages(heads, rows, ["t"], ["i"], 2, F.col("c")).collect())
    assert got == [(1, "a", 0, 2, ["c0", "c1"]), (1, "a", 1, 2, ["c2"]), (2, "b", 0, 1, [])]
    with pytest.raises(ValueError):
        decks.table_pages(heads, rows, ["t"], ["i"], 0, F.col("c"))


def test_rectangles_meet_once(spark):
    rng = random.Random(3)
    boxes = [(i % 2, i, rng.randrange(-90, 90), rng.randrange(-90, 90), rng.randrange(0, 70), rng.randrange(0, 70)) for i in range(80)]
    df = spark.createDataFrame(boxes, "g int, id int, x int, y int, w int, h int")
    got = sorted((r.g, r.id_a, r.id_b) for r in joins.overlapping_rectangles(df, ["g"], ("x", "y", "w", "h"), "id", cell=16).collect())
    hit = lambda a, b: a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    want = [(a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and min(a[4], a[5], b[4], b[5]) > 0 and hit(a, b)]
    assert got == sorted(want)


def test_signature_of_bytes(spark):
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "é漢", "x" * 300]
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", shapes.structural_signature(F.col("t")).alias("s")).collect()}
    assert got == {t: fnv(t.encode()) for t in texts}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        graph.shared_folder(Session)


def test_order_statistics(spark):
    rng = random.Random(11)
    groups = {"one": [4.0], "same": [7.0] * 9, "few": [1.0, 2.0], "many": [rng.random() ** 9 for _ in range(400)], "ties": [float(rng.randrange(5)) for _ in range(100)], "odd": [-5.0, None, 3.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None)]
    shares = {"least": 0.0, "p50": 0.5, "p95": 0.95, "most": 1.0}
    got = {r.g: tuple(r)[1:] for r in windows.order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares).select("g", "n", *shares).collect()}
    want = {}
    for g, vs in groups.items():
        own = sorted(v for v in vs if v is not None)
        want[g] = (len(own), *(own[max(1, math.ceil(len(own) * p)) - 1] for p in shares.values()))
    assert got == want


def test_walk_stops_at_its_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "source int, target int")
    root = spark.createDataFrame([(0,)], "node int")
    assert graph.reachable(edges, root, most_nodes=10).count() == 10
    with pytest.raises(RuntimeError):
        graph.reachable(edges, root, most_nodes=9)


def plain_lines(text_, most, measure):
    lines, line = [], ""
    for token in re.findall(r"\n|[ \t\r]+|[^ \t\r\n]+", text_):
        if token == "\n":
            lines.append(line.rstrip())
            line = ""
        elif token.isspace():
            if line and measure(line + token) > most:
                lines.append(line.rstrip())
                line = ""
            elif line:
                line += token
        else:
            if line and measure(line + token) > most:
                lines.append(line.rstrip())
                line = ""
            if measure(token) <= most:
                line += token
                continue
            for c in token:
                if line and measure(line + c) > most:
                    lines.append(line)
                    line = ""
                line += c
    return lines + [line.rstrip()] if line or not lines else lines


def test_wrapped_lines(spark):
    rng = random.Random(2)
    texts = ["", " ", "\n", "a\n\nb ", "x" * 95, "aa " + "W" * 30 + " b", "é漢🙂 " * 9] + ["".join(rng.choice(["a", "Wi", "m.", " ", "  ", "\n", "\t", "lll"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    wide = lambda t: sum(250 if c.isspace() else 280 if c in "il." else 850 if c in "mW" else 520 if c.isascii() else 1000 for c in t)
    for r in df.select("i", wrapping.wrapped(F.col("t"), 10).alias("a"), wrapping.wrapped(F.col("t"), 4000, lambda t: text.class_width(t, 1000)).alias("b")).collect():
        assert list(r.a) == plain_lines(texts[r.i], 10, len) and list(r.b) == plain_lines(texts[r.i], 4000, wide), (texts[r.i], r)


def rows_from_joins(df):
    """The most rows that a join of an executed frame gave."""
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        count = plan.metrics().get("numOutputRows")
        own = count.get().value() if "Join" in name and count.isDefined() else 0
        return max([own, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("kind, cell", [("int", 1), ("long", 7), ("double", 1), ("double", 5)])
def test_topmost_boxes(spark, kind, cell):
    rng = random.Random(cell)
    number = (lambda a, b: rng.randrange(a, b)) if kind != "double" else (lambda a, b: rng.choice([rng.randrange(a, b), rng.randrange(4 * a, 4 * b) / 4, rng.uniform(a, b)]) * 1.0)
    boxes = [(number(-60, 60), number(-60, 60), number(-2, 40), number(-2, 25), rng.randrange(4), i) for i in range(150)]
    boxes += [(*b[:4], b[4], b[5] + 1000) for b in boxes[:40]] + [(None, number(0, 5), number(0, 5), number(0, 5), 9, 2000)]
    points = [(i, number(-80, 90), number(-80, 90)) for i in range(300)] + [(1000 + i, b[0], b[1] + b[3]) for i, b in enumerate(boxes[:60])] + [(2000, None, number(0, 5))]
    if kind == "double":
        points += [(2001, math.nan, 0.0), (2002, math.inf, 0.0)]
    got = joins.hit(spark.createDataFrame(boxes, f"x {kind}, y {kind}, w {kind}, h {kind}, z int, id int"), spark.createDataFrame(points, f"point_id int, px {kind}, py {kind}"), cell)
    want = {}
    for n, px, py in points:
        around = [(z, i) for x, y, w, h, z, i in boxes if None not in (x, px) and x <= px <= x + w and y <= py <= y + h]
        if around:
            want[n] = max(around)
    assert {r.point_id: (r.z, r.id) for r in got.collect()} == want and len(want) > 100


def test_nested_boxes_form_no_pairs(spark):
    n = 400
    boxes = spark.range(n).selectExpr("-id x", "-id y", "2 * id + 20 w", "2 * id + 20 h", "id % 7 z", "id")
    points = spark.range(n).selectExpr("id point_id", "id % 20 px", "id div 20 py")
    top = joins.hit(boxes, points)
    assert {(r.z, r.id) for r in top.collect()} == {(6, n - 2 - (n - 2 - 6) % 7)} and top.count() == n
    assert rows_from_joins(top) < n * n / 4


@pytest.mark.parametrize("kind, cell", [("int", 1), ("long", 7), ("double", 1), ("double", 5)])
def test_innermost_intervals(spark, kind, cell):
    rng = random.Random(cell)
    number = (lambda a, b: rng.randrange(a, b)) if kind != "double" else (lambda a, b: rng.choice([rng.randrange(a, b), rng.randrange(4 * a, 4 * b) / 4, rng.uniform(a, b)]) * 1.0)
    rows = [(i % 3, a, a + number(-2, 40), i) for i in range(150) for a in [number(-60, 60)]]
    rows += [(*r[:3], r[3] + 1000) for r in rows[:40]] + [(0, None, number(0, 5), 2000), (None, number(0, 1), number(5, 6), 2001)]
    places = list({(g, number(-80, 90)) for g in (0, 1, 2, 3, None) for _ in range(100)} | {(r[0], r[k]) for r in rows[:60] for k in (1, 2)}) + [(0, None)]
    got = patches.innermost(spark.createDataFrame(rows, f"g int, start {kind}, end {kind}, id int"), spark.createDataFrame(places, f"g int, at {kind}"), ["g"], cell)
    want = {}
    for g, at in places:
        around = [(a, i) for h, a, b, i in rows if None not in (a, at, g) and g == h and a <= at < b]
        if around:
            want[g, at] = max(around)[1]
    assert {(r.g, r["at"]): r.id for r in got.collect()} == want and len(want) > 100


def test_nested_intervals_form_no_pairs(spark):
    n = 400
    rows = spark.range(n).selectExpr("1 g", "-id start", f"id + {n} end", "id")
    top = patches.innermost(rows, spark.range(n).selectExpr("1 g", "id at"), ["g"])
    assert {r.id for r in top.collect()} == {0} and top.count() == n
    assert rows_from_joins(top) < n * n / 4


def plain_column(n):
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


LONG_COLUMNS = (0, 1, 18278, 18279, 475254, 475255, 1_199_999, 12356630, 12356631, 2**31, 2**63 - 1)


def test_columns_of_five_letters_and_more(spark):
    df = spark.createDataFrame([(n,) for n in LONG_COLUMNS], "n long")
    assert {r.n: r.c for r in df.select("n", text.spreadsheet_column(F.col("n")).alias("c")).collect()} == {n: plain_column(n) for n in LONG_COLUMNS}


def test_letters_in_parentheses_of_five_letters_and_more(spark):
    df = spark.createDataFrame([(n,) for n in LONG_COLUMNS], "n long")
    got = df.select("n", text.with_affix(text.alphabetic(F.col("n")), "ParenBoth").alias("a"), text.roman(F.col("n")).alias("r")).collect()
    assert {r.n: r.a for r in got} == {n: f"({plain_column(n).lower()})" for n in LONG_COLUMNS}
    assert all(r.r == ("MMMCMXCIX" if r.n >= 3999 else "I" * r.n) for r in got)
