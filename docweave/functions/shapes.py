"""Names, roles, colours, matrices and marks of shapes, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape_xml, is_binding_id

#: Contents that each role may hold; roles that are not listed hold text or children. Fixed values.
ROLE_CONTENTS = {
    "List": ("List",),
    "Table": ("Table",),
    "Chart": ("Chart",),
    "Code": ("Code",),
    "Diagram": ("Svg",),
    "DisplayMath": ("Svg",),
    "Gallery": ("Children",),
    "Quote": ("Children",),
    "Definition": ("Children",),
    "Figure": ("Image", "Children"),
    "TableRow": (),
    "TableCell": (),
    "TableColumn": (),
}
#: Least and most slots of each layout topology. Fixed values.
TOPOLOGY_SLOTS = {
    "Stack": (1, 1),
    "TableWide": (1, 1),
    "FlowColumns": (2, 3),
    "WeightedSplit": (2, 2),
    "MediaStart": (2, 2),
    "MediaEnd": (2, 2),
    "Comparison": (2, 2),
    "PeerGrid": (2, 6),
    "Gallery": (2, 6),
    "LeadSupporting": (3, 3),
}
#: Codes of text alignment. Fixed values.
ALIGNMENTS = {"l": "Left", "ctr": "Center", "r": "Right", "just": "Justify", "justLow": "Justify", "dist": "Distributed", "thaiDist": "Distributed"}
VERTICAL_ALIGNMENTS = {"t": "Top", "ctr": "Center", "b": "Bottom"}
LINE_ENDS = {"triangle": "Triangle", "stealth": "Stealth", "diamond": "Diamond", "oval": "Oval", "arrow": "Arrow"}
_FULL = 100_000


def looked_up(names: dict[str, str], value: Column) -> Column:
    """The value's name, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value)


def resolved_name(raw: Column, scope: Column, element: Column) -> Column:
    """namespace, local and code of a qualified name under a map of prefixes; names without prefix take the default (prefix '') for elements alone."""
    cut = F.instr(raw, ":")
    prefix = F.when(cut > 0, F.substring(raw, F.lit(1), cut - 1))
    found = F.when(prefix.isNotNull(), F.element_at(scope, prefix)).when(element, F.element_at(scope, ""))
    code = F.when(prefix.isNotNull() & found.isNull(), "UNDECLARED_PREFIX")
    return F.struct(found.alias("namespace"), F.substring(raw, cut + 1, F.char_length(raw)).alias("local"), code.alias("code"))


def metadata_binding(description: Column, domain: str) -> Column:
    """kind and id of a binding that a description of the form ``domain:kind:id`` declares, or null."""
    parts = F.split(description, ":", 3)
    kind = looked_up({"text": "Text", "image": "Image", "chart": "Chart"}, F.get(parts, F.lit(1)))
    return F.when((F.get(parts, F.lit(0)) == domain) & kind.isNotNull() & is_binding_id(F.get(parts, F.lit(2))), F.struct(kind.alias("kind"), F.get(parts, F.lit(2)).alias("id")))


def bears_topology(name: Column) -> Column:
    """Whether a part decides what the package's graph looks like."""
    return (name == "[Content_Types].xml") | name.endswith(".rels") | name.endswith("/presentation.xml") | (name == "ppt/presentation.xml")


def regenerated_folder(name: Column) -> Column:
    """Whether a part lies where slides and notes are made anew."""
    return name.startswith("ppt/slides/") | name.startswith("ppt/notesSlides/")


def role_allows(role: Column, content: Column) -> Column:
    """Whether a node's role may hold its content, inline pictures apart."""
    allowed = F.create_map(*(x for role_, own in ROLE_CONTENTS.items() for x in (F.lit(role_), F.array(*map(F.lit, own)) if own else F.array().cast("array<string>"))))
    return F.coalesce(F.array_contains(F.element_at(allowed, role), content), content.isin("Text", "Children"))


def inline_picture_allowed(role: Column, parent_role: Column, parent_content: Column, siblings: Column) -> Column:
    """Whether a picture in running text stands where it may: below children of its own role that are texts and pictures alone, both present. ``siblings`` are (role, content) of all children."""
    alike = F.forall(siblings, lambda s: (s["role"] == parent_role) & s["content"].isin("Text", "Svg"))
    both = F.exists(siblings, lambda s: s["content"] == "Text") & F.exists(siblings, lambda s: s["content"] == "Svg")
    return F.coalesce(parent_role.isin("Prose", "Subtitle") & (parent_role == role) & (parent_content == "Children") & alike & both, F.lit(False))


def topology_valid(kind: Column, slots: Column) -> Column:
    least, most = (looked_up_number({k: v[i] for k, v in TOPOLOGY_SLOTS.items()}, kind) for i in (0, 1))
    return F.coalesce(slots.between(least, most), F.lit(False))


def looked_up_number(values: dict[str, int], value: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), value)


def hex_color(value: Column) -> Column:
    return F.regexp_like(value, F.lit("^[0-9A-Fa-f]{6}$"))


def shape_verdict(copies: Column, runs: Column, fill: Column, link: Column) -> Column:
    """``ok`` or the first rule that a shape's data break; ``runs`` are (font_size, color). Absent values break none."""
    safe = reduce(lambda a, b: a | b, (link.startswith(s) for s in ("https://", "http://", "mailto:", "tel:")))
    run = lambda r: F.when((r["font_size"] < 100) | (r["font_size"] > 40_000), "FONT_SIZE").when(~hex_color(r["color"]), "RUN_COLOR")
    first_run = F.element_at(F.concat(F.filter(F.transform(runs, run), lambda c: c.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    return F.coalesce(
        F.when(copies > 10_000, F.lit("COPIES")),
        F.when(F.size(runs) > 10_000, F.lit("RUNS")),
        first_run,
        F.when(~hex_color(fill), F.lit("FILL_COLOR")),
        F.when(~safe, F.lit("LINK")),
        F.lit("ok"),
    )


def _div(a: Column, b: Column | int) -> Column:
    """Whole division towards zero."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long") if isinstance(b, int) else b.cast("long"))


def _channel(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(255)).cast("int")


def _bound(value: Column, use) -> Column:
    """What ``use`` makes of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hsl(c: Column) -> Column:
    """Hue, saturation and lightness of a colour."""

    def made(v: Column) -> Column:
        red, green, blue = v["red"], v["green"], v["blue"]
        delta, light = v["high"] - v["low"], (v["high"] + v["low"]) / 2
        grey = delta < 2.220446049250313e-16
        sixth = F.when(v["high"] == red, F.pmod((green - blue) / delta, F.lit(6.0))).when(v["high"] == green, (blue - red) / delta + 2).otherwise((red - green) / delta + 4)
        return F.struct(F.when(grey, 0.0).otherwise(60 * sixth).alias("hue"), F.when(grey, 0.0).otherwise(delta / (1 - F.abs(2 * light - 1))).alias("saturation"), light.alias("light"))

    red, green, blue = (c[k] / F.lit(255.0) for k in ("red", "green", "blue"))
    return _bound(F.struct(red.alias("red"), green.alias("green"), blue.alias("blue"), F.greatest(red, green, blue).alias("high"), F.least(red, green, blue).alias("low")), made)


def _rgb(hsl: Column, alpha: Column) -> Column:
    """The colour of a hue, saturation and lightness."""

    def made(v: Column) -> Column:
        second, zero, n = v["chroma"] * (1 - F.abs(F.pmod(v["sector"], F.lit(2.0)) - 1)), F.lit(0.0), F.floor(v["sector"])
        pick = lambda *values: reduce(lambda rest, i: F.when(n == i, values[i]).otherwise(rest), range(4, -1, -1), values[5])
        chroma = v["chroma"]
        red = pick(chroma, second, zero, zero, second, chroma)
        green = pick(second, chroma, chroma, second, zero, zero)
        blue = pick(zero, zero, second, chroma, chroma, second)
        whole = lambda x: _channel(F.floor((x + v["light"] - chroma / 2) * 255 + 0.5))
        return F.struct(whole(red).alias("red"), whole(green).alias("green"), whole(blue).alias("blue"), alpha.alias("alpha"))

    chroma = (1 - F.abs(2 * hsl["light"] - 1)) * hsl["saturation"]
    return _bound(F.struct(chroma.alias("chroma"), (F.pmod(hsl["hue"], F.lit(360.0)) / 60).alias("sector"), hsl["light"].alias("light")), made)


def transformed_color(color: Column, transforms: Column) -> Column:
    """A colour (red, green, blue, alpha) after transforms (kind, value in 1/100 000) in their order. Unknown kinds change nothing."""

    def step(c: Column, t: Column) -> Column:
        kind, value = t["kind"], t["value"].cast("long")
        share = F.least(F.greatest(value, F.lit(0)), F.lit(_FULL)).cast("long")
        make = lambda red, green, blue, alpha: F.struct(red.cast("int").alias("red"), green.cast("int").alias("green"), blue.cast("int").alias("blue"), alpha.cast("int").alias("alpha"))
        r, g, b, a = c["red"], c["green"], c["blue"], c["alpha"]
        shade = lambda x: _channel(_div(x * share, _FULL))
        tint = lambda x: _channel(x + _div((255 - x) * share, _FULL))
        moved = lambda x: _channel(x + _div(255 * value, _FULL))
        grey = F.floor((r * 21 + g * 72 + b * 7) / 100)
        part, clamp = value / F.lit(100_000.0), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

        def shifted(v: Column) -> Column:
            own = lambda name, off: F.when(kind == f"{name}Mod", v[field[name]] * part).when(kind == f"{name}Off", v[field[name]] + off).otherwise(v[field[name]])
            field = {"hue": "hue", "sat": "saturation", "lum": "light"}
            moved_hsl = F.struct(own("hue", value / F.lit(60_000.0)).alias("hue"), clamp(own("sat", part)).alias("saturation"), clamp(own("lum", part)).alias("light"))
            return _bound(moved_hsl, lambda m: _rgb(m, a))

        return (
            F.when(kind == "alpha", make(r, g, b, _div(255 * share, _FULL)))
            .when(kind == "alphaMod", make(r, g, b, _div(a * share, _FULL)))
            .when(kind == "alphaOff", make(r, g, b, moved(a)))
            .when(kind.isin("inv", "comp"), make(255 - r, 255 - g, 255 - b, a))
            .when(kind == "gray", make(grey, grey, grey, a))
            .when(kind == "redMod", make(shade(r), g, b, a))
            .when(kind == "greenMod", make(r, shade(g), b, a))
            .when(kind == "blueMod", make(r, g, shade(b), a))
            .when(kind == "redOff", make(moved(r), g, b, a))
            .when(kind == "greenOff", make(r, moved(g), b, a))
            .when(kind == "blueOff", make(r, g, moved(b), a))
            .when(kind.isin("lumMod", "lumOff", "satMod", "satOff", "hueMod", "hueOff"), _bound(_hsl(c), shifted))
            .when(kind == "tint", make(tint(r), tint(g), tint(b), a))
            .when(kind == "shade", make(shade(r), shade(g), shade(b), a))
            .otherwise(c)
        )

    return F.aggregate(transforms, color, step)


def matrix(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """x' = a x + c y + e, y' = b x + d y + f."""
    return F.struct(*(v.cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), "abcdef")))


def product(left: Column, right: Column) -> Column:
    m = lambda x, y, z, w: left[x] * right[y] + left[z] * right[w]
    return matrix(m("a", "a", "c", "b"), m("b", "a", "d", "b"), m("a", "c", "c", "d"), m("b", "c", "d", "d"), m("a", "e", "c", "f") + left["e"], m("b", "e", "d", "f") + left["f"])


def composed(matrices: Column) -> Column:
    """All matrices of an array, outermost first, as one."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.aggregate(matrices, matrix(one, zero, zero, one, zero, zero), product)


def moved_point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def group_matrix(x: Column, y: Column, width: Column, height: Column, child: tuple[Column, Column, Column, Column], flip_x: Column, flip_y: Column, turn: Column) -> Column:
    """From a group's own coordinates (child: x, y, width, height) to its frame, flipped and turned (in 1/60 000 degrees) about its middle."""
    one, zero = F.lit(1.0), F.lit(0.0)
    shift = lambda u, v: matrix(one, zero, zero, one, u, v)
    scale = lambda u, v: matrix(u, zero, zero, v, zero, zero)
    angle = F.radians(turn / F.lit(60_000.0))
    cx, cy, cw, ch = child
    steps = (
        shift(x + width / 2, y + height / 2),
        matrix(F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle), zero, zero),
        scale(F.when(flip_x, -1.0).otherwise(1.0), F.when(flip_y, -1.0).otherwise(1.0)),
        shift(-width / 2, -height / 2),
        scale(F.when(cw == 0, 1.0).otherwise(width / cw), F.when(ch == 0, 1.0).otherwise(height / ch)),
        shift(-cx, -cy),
    )
    return composed(F.array(*steps))


def run_markup(run: Column) -> Column:
    """A text run (text, bold, italic, underline, font_size, color; any but the text may be null) as markup."""
    flag = lambda field, name, on, off: F.when(run[field], f' {name}="{on}"').when(~run[field], f' {name}="{off}"').otherwise("")
    size = F.when(run["font_size"].isNotNull(), F.concat(F.lit(' sz="'), run["font_size"].cast("string"), F.lit('"'))).otherwise("")
    fill = F.when(run["color"].isNull(), "/>").otherwise(F.concat(F.lit('><a:solidFill><a:srgbClr val="'), run["color"], F.lit('"/></a:solidFill></a:rPr>')))
    head = F.concat(F.lit("<a:r><a:rPr"), flag("bold", "b", "1", "0"), flag("italic", "i", "1", "0"), flag("underline", "u", "sng", "none"), size, fill)
    return F.concat(head, F.lit("<a:t>"), escape_xml(run["text"], quotes=False), F.lit("</a:t></a:r>"))


def structural_signature(content: Column) -> Column:
    """FNV-1a over bytes, as 16 hexadecimal digits. The product is made of 32-bit halves, for whole numbers here do not wrap."""
    data = content.cast("binary")
    low32 = F.lit((1 << 32) - 1)
    # the offset basis in halves, and the prime as 2**40 + 0x1B3
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))

    def step(acc: Column, i: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
        times = low * 0x1B3
        high = acc["high"] * 0x1B3 + F.shiftright(times, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(low32).alias("high"), times.bitwiseAND(low32).alias("low"))

    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.lower(F.aggregate(places, start, step, lambda acc: F.concat(F.lpad(F.hex(acc["high"]), 8, "0"), F.lpad(F.hex(acc["low"]), 8, "0"))))


def cover_loss(image: tuple[Column, Column], frame: tuple[Column, Column]) -> Column:
    """Thousandths of a picture that are cut off where it covers a frame."""
    iw, ih = (v.cast("decimal(19,0)") for v in image)
    fw, fh = (F.greatest(v, F.lit(1)).cast("decimal(19,0)") for v in frame)
    a, b = (iw * fh).cast("decimal(34,0)"), (fw * ih).cast("decimal(34,0)")
    small, large = F.least(a, b), F.greatest(a, b)
    return F.call_function("div", (large - small) * F.lit(1000).cast("decimal(4,0)"), F.greatest(large, F.lit(1).cast("decimal(34,0)")))


def unused_share(slot: tuple[Column, Column], seen: tuple[Column, Column]) -> Column:
    """Thousandths of a slot that a contained picture leaves empty."""
    area = lambda pair: F.greatest(pair[0], F.lit(1)).cast("decimal(17,0)") * F.greatest(pair[1], F.lit(1)).cast("decimal(17,0)")
    whole, used = area(slot).cast("decimal(34,0)"), area(seen).cast("decimal(34,0)")
    return F.call_function("div", F.greatest(whole - used, F.lit(0).cast("decimal(34,0)")) * F.lit(1000).cast("decimal(4,0)"), whole)


def image_size(content: Column) -> Column:
    """Width and height from the header of a PNG or GIF, or null."""
    big = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    small = lambda at: F.conv(F.concat(F.hex(F.substring(content, at + 1, 1)), F.hex(F.substring(content, at, 1))), 16, 10).cast("int")
    png, gif = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.hex(F.substring(content, 1, 6)).isin("474946383761", "474946383961")
    return F.when(png, F.struct(big(17).alias("width"), big(21).alias("height"))).when(gif, F.struct(small(7).alias("width"), small(9).alias("height")))
