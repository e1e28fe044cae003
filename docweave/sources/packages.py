"""ZIP packages as tables: entries, their payloads, XML tokens; and back.

Packages come as rows (package_id, content); ``spark.read.format("binaryFile")``
gives such rows for files. Each package is read by one task in bounded memory: the
index first, payloads one at a time. Damage becomes an ``error``, never an exception.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits on what an untrusted package may ask for.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_RATIO = 10_000, 256 << 20, 1_000
ENTRIES = "package_id string, seq int, name string, compression string, crc32 long, csize long, usize long, offset long, payload binary, error string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """package_id (the file's path) and content of files below ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("package_id"), "content")


def scan_entries(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each entry of each package; an unreadable package is one row with an error."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENTRIES.split(", ")]
        for frame in frames:
            for package_id, content in zip(frame["package_id"], frame["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        infos = archive.infolist()
                        if len(infos) > MOST_ENTRIES:
                            raise ValueError("ENTRY_LIMIT")
                        for seq, info in enumerate(infos):
                            rows.append((package_id, seq, info.filename, {0: "stored", 8: "deflate"}.get(info.compress_type, "other"), info.CRC, info.compress_size, info.file_size, info.header_offset, *_payload(archive, info, payloads)))
                except (zipfile.BadZipFile, ValueError, NotImplementedError, OSError) as e:
                    rows.append((package_id, None, None, None, None, None, None, None, None, str(e) or type(e).__name__))
                for at in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[at : at + 64], columns=columns)

    return packages.select(F.col("package_id").cast("string").alias("package_id"), "content").mapInPandas(scan, ENTRIES)


def _payload(archive: zipfile.ZipFile, info: zipfile.ZipInfo, wanted: bool) -> tuple[bytes | None, str | None]:
    if not wanted or info.is_dir():
        return None, None
    if info.file_size > MOST_ENTRY_BYTES or info.file_size > MOST_RATIO * max(1, info.compress_size):
        return None, "SIZE_LIMIT"
    try:
        return archive.read(info), None
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
        return None, type(e).__name__


def verified(entries: DataFrame) -> DataFrame:
    """``entries`` with ``intact``: the payload's size and CRC-32 agree with the index."""
    return entries.withColumn("intact", (F.octet_length("payload") == F.col("usize")) & (F.crc32("payload") == F.col("crc32")))


def overlapping_entries(entries: DataFrame) -> DataFrame:
    """Entries that begin before the one before them ends (headers not counted)."""
    w = Window.partitionBy("package_id").orderBy("offset", "seq")
    return entries.withColumn("before", F.lag(F.col("offset") + F.col("csize")).over(w)).filter(F.col("before") > F.col("offset")).drop("before")


def write_packages(parts: DataFrame) -> DataFrame:
    """package_id and content of packages built of ``parts`` (package_id, name, content), in order of name. A package is one row, so it must fit a task."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in sorted(zip(frame["name"], frame["content"])):
                archive.writestr(zipfile.ZipInfo(name), bytes(content), compress_type=zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"package_id": [frame["package_id"].iloc[0]], "content": [out.getvalue()]})

    return parts.select(F.col("package_id").cast("string").alias("package_id"), "name", "content").groupBy("package_id").applyInPandas(build, "package_id string, content binary")


TOKENS = "array<struct<seq:int,kind:string,name:string,attrs:map<string,string>,start:int,end:int,depth:int>>"


def xml_tokens(text: Column) -> Column:
    """Tokens of an XML text with byte ranges and depth; null where it is not well formed or declares a document type."""

    @F.pandas_udf(TOKENS)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(_tokens)

    return scan(text)


def _tokens(text: str | None) -> list[dict] | None:
    from xml.parsers import expat

    if text is None:
        return None
    parser, out, depth = expat.ParserCreate(), [], 0
    data = text.encode("utf-8")

    def add(kind: str, name: str | None = None, attrs: dict | None = None) -> None:
        out.append({"seq": len(out), "kind": kind, "name": name, "attrs": attrs, "start": parser.CurrentByteIndex, "end": None, "depth": depth})

    def start(name: str, attrs: dict) -> None:
        nonlocal depth
        depth += 1
        add("Start", name, attrs)

    def end(name: str) -> None:
        nonlocal depth
        add("End", name)
        depth -= 1

    def refuse(*_: object) -> None:
        raise ValueError("document type")

    parser.buffer_text = False
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: add("Text", s)
    parser.CommentHandler = lambda s: add("Comment", s)
    parser.ProcessingInstructionHandler = lambda target, s: add("PI", target)
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError):
        return None
    ends = [t["start"] for t in out[1:]] + [len(data)]
    for token, stop in zip(out, ends):
        token["end"] = stop
    return out


def token_rows(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """keys and the token columns, one row for each token."""
    return df.select(*keys, F.explode(xml_tokens(text)).alias("t")).select(*keys, "t.*")

