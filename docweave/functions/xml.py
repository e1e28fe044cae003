"""Typed reads of package XML by Spark's own parser: each gives columns of a schema, none fails the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_binding_id

_SLIDES = "`p:sldIdLst` struct<`p:sldId`: array<struct<`_r:id`: string>>>"
_SHAPES = "`p:cSld` struct<`p:spTree`: struct<`p:sp`: array<struct<`p:nvSpPr`: struct<`p:cNvPr`: struct<_id: long, _name: string, _descr: string>>, `p:txBody`: struct<`a:p`: array<struct<`a:r`: array<struct<`a:t`: string>>>>>>>>>"
_MANIFEST = "bind array<struct<_id: string, _kind: string, _part: string, _shapeId: string, _shapeName: string>>"
#: Colour slots of a theme. Fixed values.
COLOR_SLOTS = ("dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
_COLOR = "struct<`a:srgbClr`: struct<_val: string>, `a:sysClr`: struct<_lastClr: string>>"
_FONTS = "struct<`a:latin`: struct<_typeface: string>, `a:ea`: struct<_typeface: string>, `a:cs`: struct<_typeface: string>>"
_THEME = "`a:themeElements` struct<`a:clrScheme`: struct<" + ", ".join(f"`a:{s}`: {_COLOR}" for s in COLOR_SLOTS) + f">, `a:fontScheme`: struct<`a:majorFont`: {_FONTS}, `a:minorFont`: {_FONTS}>>"


def _read(xml: Column, schema: str) -> Column:
    return F.from_xml(xml, schema, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})


def slide_ids(xml: Column) -> Column:
    """Relationship ids of a presentation's slides, in order."""
    return F.transform(_read(xml, _SLIDES)["p:sldIdLst"]["p:sldId"], lambda s: s["_r:id"])


def shapes(xml: Column) -> Column:
    """id, name, description and text of a slide's shapes, in order."""
    text = lambda body: F.array_join(F.transform(body["a:p"], lambda p: F.array_join(F.transform(p["a:r"], lambda r: r["a:t"]), "")), "\n")
    one = lambda s: F.struct(
        s["p:nvSpPr"]["p:cNvPr"]["_id"].alias("id"), s["p:nvSpPr"]["p:cNvPr"]["_name"].alias("name"), s["p:nvSpPr"]["p:cNvPr"]["_descr"].alias("description"), text(s["p:txBody"]).alias("text")
    )
    return F.transform(_read(xml, _SHAPES)["p:cSld"]["p:spTree"]["p:sp"], one)


def manifest(xml: Column) -> Column:
    """id, kind, part, shape_id, shape_name and code of a manifest's declarations: null, or INVALID_MANIFEST where something needed is missing or bad."""

    def one(b: Column) -> Column:
        number = F.when(F.regexp_like(b["_shapeId"], F.lit(r"^\+?[0-9]{1,10}$")), b["_shapeId"].cast("long"))
        shape = F.when(number <= 0xFFFFFFFF, number)
        whole = b["_id"].isNotNull() & b["_kind"].isNotNull() & b["_part"].isNotNull()
        good = F.coalesce(whole & is_binding_id(b["_id"]) & (shape.isNotNull() | b["_shapeName"].isNotNull()), F.lit(False))
        part = F.regexp_replace(b["_part"], "^/+", "")
        fields = {"id": b["_id"], "kind": b["_kind"], "part": part, "shape_id": shape, "shape_name": b["_shapeName"]}
        return F.struct(*(F.when(whole, v).alias(n) for n, v in fields.items()), F.when(~good, "INVALID_MANIFEST").alias("code"))

    return F.transform(_read(xml, _MANIFEST)["bind"], one)


def theme_colors(xml: Column) -> Column:
    """slot and rgb of a theme's colours, by slot; slots without a colour are left out."""
    scheme = _read(xml, _THEME)["a:themeElements"]["a:clrScheme"]
    slots = F.array(*(F.struct(F.lit(s).alias("slot"), F.coalesce(scheme[f"a:{s}"]["a:srgbClr"]["_val"], scheme[f"a:{s}"]["a:sysClr"]["_lastClr"]).alias("rgb")) for s in sorted(COLOR_SLOTS)))
    return F.filter(slots, lambda c: c["rgb"].isNotNull())


def theme_fonts(xml: Column) -> Column:
    """latin, east_asian and complex_script of a theme's major and minor fonts."""
    fonts = _read(xml, _THEME)["a:themeElements"]["a:fontScheme"]
    names = lambda f: F.struct(f["a:latin"]["_typeface"].alias("latin"), f["a:ea"]["_typeface"].alias("east_asian"), f["a:cs"]["_typeface"].alias("complex_script"))
    return F.struct(names(fonts["a:majorFont"]).alias("major"), names(fonts["a:minorFont"]).alias("minor"))
