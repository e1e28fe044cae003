"""Sentence-aware slices of long texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BYTES = 512
#: White space of any script. Fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Between a sentence's last sign and white space, or between two line feeds.
_ENDS = re.compile(f"(?<=[.?!。？！])(?=[{SPACE}])|(?<=\n)(?=\n)")
#: A line may break behind white space.
_BREAK = re.compile(f"(?<=[{SPACE}])(?=[^{SPACE}])")


def text_slices(text: Column) -> Column:
    """Places (code points) of slices that cover a text in order, each of at most 512 bytes: before the white space behind a sentence and between two line feeds; a longer stretch at its last line break within 512 bytes, else between characters."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(slices)

    return cut(text)


def slices(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    out, begin = [], 0
    for end in [*(m.start() for m in _ENDS.finditer(text)), len(text)]:
        while begin < end:
            stop = end
            # no more than a window of the text is looked at for each slice
            window = text[begin : min(end, begin + MOST_BYTES + 1)].encode("utf-8")
            if len(window) > MOST_BYTES:
                most = begin + len(window[:MOST_BYTES].decode("utf-8", "ignore"))
                cuts = [m.start() for m in _BREAK.finditer(text, begin + 1, most + 1)]
                stop = cuts[-1] if cuts else most
            out.append({"start": begin, "end": stop})
            begin = stop
    return out
