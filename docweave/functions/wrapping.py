"""Lines of a text under a width, as columns: greedy filling at white space, words that fit no line cut between characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = r"\n|[ \t\r]+|[^ \t\r\n]+"
_STATE = "struct<line:string,width:bigint,lines:array<string>>"


def wrapped(text: Column, most: int, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """Lines of at most ``most`` units each. ``measure`` gives the width of a text as a whole number and must be additive over its characters; a character that is wider than a line has one of its own."""
    width = lambda t: measure(t).cast("long")
    none = F.array().cast("array<string>")
    state = lambda line, used, lines: F.struct(line.alias("line"), used.alias("width"), lines.alias("lines"))
    empty, zero = F.lit(""), F.lit(0).cast("long")
    end = lambda line: F.regexp_replace(line, r"\s+$", "")
    pushed = lambda s: F.concat(s["lines"], F.array(end(s["line"])))

    def cut(token: Column) -> Column:
        """A long word's full lines, and what is left for the next."""
        chars = F.transform(F.sequence(F.lit(1), F.char_length(token)), lambda i: F.substring(token, i, F.lit(1)))

        def add(s: Column, c: Column) -> Column:
            over = (s["line"] != "") & (s["width"] + width(c) > most)
            return F.when(over, state(c, width(c), F.concat(s["lines"], F.array(s["line"])))).otherwise(state(F.concat(s["line"], c), s["width"] + width(c), s["lines"]))

        return F.aggregate(chars, state(empty, zero, none).cast(_STATE), lambda s, c: add(s, c).cast(_STATE))

    def word(s: Column, token: Column) -> Column:
        fresh = (s["line"] != "") & (s["width"] + width(token) > most)
        lines = F.when(fresh, pushed(s)).otherwise(s["lines"])
        line, used = F.when(fresh, empty).otherwise(s["line"]), F.when(fresh, zero).otherwise(s["width"])
        pieces = cut(token)
        return F.when(width(token) <= most, state(F.concat(line, token), used + width(token), lines)).otherwise(state(pieces["line"], pieces["width"], F.concat(lines, pieces["lines"])))

    def step(s: Column, token: Column) -> Column:
        blank = F.regexp_like(token, F.lit(r"^[ \t\r]"))
        over = s["width"] + width(token) > most
        return (
            F.when(token == "\n", state(empty, zero, pushed(s)))
            .when(blank & (s["line"] == ""), s)
            .when(blank & over, state(empty, zero, pushed(s)))
            .when(blank, state(F.concat(s["line"], token), s["width"] + width(token), s["lines"]))
            .otherwise(word(s, token))
        ).cast(_STATE)

    tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
    finish = lambda s: F.when((s["line"] != "") | (F.size(s["lines"]) == 0), pushed(s)).otherwise(s["lines"])
    return F.aggregate(tokens, state(empty, zero, none).cast(_STATE), step, finish)
