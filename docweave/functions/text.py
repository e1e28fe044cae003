"""Text expressions of the package model, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that XML text and attributes escape, the ampersand first. Fixed values.
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
BINDING_ID = "^[A-Za-z0-9_.-]{1,128}$"
TOKEN = r"\{\{(.*?)\}\}"


def escape_xml(text: Column, quotes: bool = True) -> Column:
    for plain, entity in XML_ESCAPES[: 5 if quotes else 3]:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def decode_named_entities(text: Column) -> Column:
    """The five named entities, the ampersand last, so that nothing is decoded twice."""
    for plain, entity in reversed(XML_ESCAPES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def decode_entities(text: Column) -> Column:
    """A struct of the text with named and numeric references decoded, and ``code``: null, or what is wrong with the first bad reference (then the text is null).

    ``UNTERMINATED``: no semicolon follows; ``UNSUPPORTED``: another name;
    ``INVALID_NUMERIC``: no number, or one that is no character.
    """
    pieces = F.split(text, "&", -1)
    named = F.create_map(*(F.lit(x) for plain, entity in XML_ESCAPES for x in (entity[1:-1], plain)))

    closed = F.array_max(F.transform(pieces, lambda p, i: F.when(F.contains(p, F.lit(";")), i).otherwise(-1)))

    def one(piece: Column, i: Column) -> Column:
        stop = F.instr(piece, ";")
        entity, rest = F.substring(piece, F.lit(1), stop - 1), F.substring(piece, stop + 1, F.char_length(piece))
        digits = F.ltrim(F.regexp_replace(entity, r"^#x?\+?", ""), F.lit("0"))
        plain = F.regexp_like(entity, F.lit(r"^#x\+?[0-9A-Fa-f]+$|^#\+?[0-9]+$")) & (F.char_length(digits) <= 10)
        value = F.when(plain, F.when(entity.startswith("#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"))
        value = F.coalesce(value, F.when(plain & (digits == ""), 0))
        good = (value < 0xD800) | value.between(0xE000, 0x10FFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")
        # a reference without a semicolon reaches to the next one, over other references
        code = (
            F.when((stop == 0) & (closed <= i + 1), F.lit("UNTERMINATED"))
            .when((stop > 0) & F.element_at(named, entity).isNotNull(), F.lit(None))
            .when(~piece.startswith("#"), F.lit("UNSUPPORTED"))
            .when((stop == 0) | ~F.coalesce(good, F.lit(False)), F.lit("INVALID_NUMERIC"))
        )
        return F.struct(F.concat(F.coalesce(F.element_at(named, entity), F.when(good, sign)), rest).alias("text"), code.alias("code"))

    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one)
    wrong = F.element_at(F.concat(F.filter(F.transform(rest, lambda r: r["code"]), lambda c: c.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    whole = F.concat(F.element_at(pieces, 1), F.array_join(F.transform(rest, lambda r: r["text"]), ""))
    return F.struct(F.when(wrong.isNull(), whole).alias("text"), wrong.alias("code"))


def is_binding_id(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(BINDING_ID)), F.lit(False))


def visible_tokens(text: Column) -> Column:
    """Ids of ``{{id}}`` tokens from left to right; those that are no binding ids are passed over."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?s)" + TOKEN), F.lit(1)), is_binding_id)


def resolve_path(base: Column, target: Column) -> Column:
    """``target`` seen from part ``base``: without its fragment, from the root if it begins with ``/``; null where it leaves the root or holds a backslash or NUL."""
    path = F.regexp_replace(target, "#.*$", "")
    folder = F.regexp_replace(base, "[^/]*$", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    unsafe = F.array(F.lit("!"))
    steps = F.aggregate(
        F.split(whole, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(F.element_at(F.concat(acc, F.array(F.lit(""))), 1) == "!", acc)
        .when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) == 0), unsafe)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    bad = F.contains(path, F.lit("\\")) | F.contains(path, F.lit("\u0000"))
    return F.when(~bad & (F.element_at(F.concat(steps, F.array(F.lit(""))), 1) != "!"), F.array_join(steps, "/"))


def rels_name(part: Column) -> Column:
    """Name of the part that holds a part's relationships."""
    return F.regexp_replace(part, r"^(.*/)?([^/]+)$", "$1_rels/$2.rels")


def owner_of_rels(name: Column) -> Column:
    """The part whose relationships a part holds, or null."""
    return F.when(F.regexp_like(name, F.lit(r"^(.*/)?_rels/[^/]+\.rels$")), F.regexp_replace(name, r"^(.*/)?_rels/([^/]+)\.rels$", "$1$2"))


def safe_name(name: Column) -> Column:
    """Whether a part name stays inside the package: no leading ``/``, backslash, NUL, drive, ``.`` or ``..`` segment."""
    return ~(name.startswith("/") | F.contains(name, F.lit("\\")) | F.contains(name, F.lit("\u0000")) | F.regexp_like(name, F.lit("^[A-Za-z]:")) | F.exists(F.split(name, "/"), lambda s: s.isin(".", "..")))


def safe_link(url: Column) -> Column:
    """The kind of a hyperlink that is safe to keep, or null."""
    odd = F.regexp_like(url, F.lit(r"^\s|\s$|[\x00-\x1F\x7F]"))
    kind = F.when(url.startswith("http://") | url.startswith("https://"), "Web").when(url.startswith("mailto:"), "Email").when(url.startswith("tel:"), "Telephone").when(F.regexp_like(url, F.lit("^#.")), "Anchor")
    return F.when(~odd, kind)


def line_count(text: Column, per_line: int) -> Column:
    """Lines that a text fills: each piece between line feeds takes at least one."""
    pieces = F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)
    return F.greatest(F.lit(1), F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, p: acc + F.ceil(F.greatest(F.char_length(p), F.lit(1)) / per_line)))


#: Advance of characters by class, in thousandths of the font size; the first class that holds a character counts. Fixed values.
CLASS_WIDTHS = (
    (r"[\p{IsWhite_Space}]", 250),
    ("[ijlI|!.,:;'`]", 280),
    (r"[frt()\[\]{}/-]", 360),
    ("[mwMW@%&]", 850),
    ("[A-Z]", 650),
    ("[a-z]", 520),
    ("[0-9]", 560),
    ("[\\x21-\\x7E]", 400),
)
OTHER_WIDTH = 1000


def class_width(text: Column, size: int) -> Column:
    """Advance of a text in a font size: per-mille widths by class of character, whole numbers."""
    left, total = text, F.lit(0).cast("long")
    for pattern, width in CLASS_WIDTHS:
        rest = F.regexp_replace(left, pattern, "")
        total = total + (F.char_length(left) - F.char_length(rest)) * width
        left = rest
    return F.call_function("div", (total + F.char_length(left) * OTHER_WIDTH) * size, F.lit(1000).cast("long"))


def spreadsheet_column(n: Column) -> Column:
    """1 is A, 26 is Z, 27 is AA, and so on for as many letters as it takes."""
    n = n.cast("long")
    start = F.struct(n.alias("left"), F.lit("").alias("out"))
    letter = lambda k: F.chr(F.lit(65) + k % 26)
    step = lambda acc: F.struct(F.call_function("div", acc["left"] - 1, F.lit(26).cast("long")).alias("left"), F.concat(letter(acc["left"] - 1), acc["out"]).alias("out"))
    # 14 letters hold every 64-bit number
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, lambda acc, _: F.when(acc["left"] > 0, step(acc)).otherwise(acc), lambda acc: acc["out"])


def roman(n: Column) -> Column:
    """Roman numerals of 1 to 3999 (larger numbers are taken as 3999)."""
    n, out = F.least(n, F.lit(3999)), F.lit("")
    for value, letters in ((1000, ("", "M", "MM", "MMM")), (100, ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), (10, ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), (1, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))):
        digit = F.floor(n / value) % 10
        out = F.concat(out, F.element_at(F.array(*map(F.lit, letters)), digit.cast("int") + 1))
    return out


def ordinal(n: Column) -> Column:
    teen = (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(~teen & (n % 10 == 1), "st").when(~teen & (n % 10 == 2), "nd").when(~teen & (n % 10 == 3), "rd").otherwise("th"))


def alphabetic(n: Column) -> Column:
    """Bijective base 26 in small letters."""
    return F.lower(spreadsheet_column(n))


def auto_number(n: Column, scheme: Column) -> Column:
    """A paragraph's number in a scheme: its beginning names the digits, its end the signs around them."""
    circled = F.element_at(F.array(*(F.lit(chr(0x245F + i)) for i in range(1, 21))), F.least(F.greatest(n, F.lit(1)), F.lit(20)).cast("int"))
    body = (
        F.when(scheme.startswith("alphaLc"), alphabetic(F.greatest(n, F.lit(1))))
        .when(scheme.startswith("alphaUc"), spreadsheet_column(F.greatest(n, F.lit(1))))
        .when(scheme.startswith("romanLc"), F.lower(roman(n)))
        .when(scheme.startswith("romanUc"), roman(n))
        .when(scheme.startswith("ordinal"), ordinal(n))
        .when(scheme.startswith("circleNum") & n.between(1, 20), circled)
        .otherwise(n.cast("string"))
    )
    return (
        F.when(scheme.endswith("ParenBoth"), F.concat(F.lit("("), body, F.lit(")")))
        .when(scheme.endswith("ParenR"), F.concat(body, F.lit(")")))
        .when(scheme.endswith("Period"), F.concat(body, F.lit(".")))
        .otherwise(body)
    )


def with_affix(number: Column, style: str) -> Column:
    """``ParenBoth``: (x), ``ParenR``: x), ``Period``: x., else x."""
    return {"ParenBoth": F.concat(F.lit("("), number, F.lit(")")), "ParenR": F.concat(number, F.lit(")")), "Period": F.concat(number, F.lit("."))}.get(style, number)


def paragraph_markers(text: Column, marker: str = "• ") -> Column:
    """The marker before every line that is not empty."""
    return F.regexp_replace(text, "(?m)^(?=[^\n])", marker)
