"""Chart data as workbook cells and references, and the content types that images need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import spreadsheet_column

SHEET = "Sheet1"


def workbook_cells(data: DataFrame, chart: str) -> DataFrame:
    """chart, row, column, cell and value of the sheet behind each chart. ``data`` has chart, category_no and series_no (from 0), category, series and value; categories stand in the first column, series in the first row."""
    named = lambda df, row, column, value: df.select(chart, row.cast("int").alias("row"), column.cast("int").alias("column"), value.cast("string").alias("value"))
    categories = data.groupBy(chart, "category_no").agg(F.min("category").alias("category"))
    series = data.groupBy(chart, "series_no").agg(F.min("series").alias("series"))
    cells = (
        named(categories, F.col("category_no") + 2, F.lit(1), F.col("category"))
        .unionByName(named(series, F.lit(1), F.col("series_no") + 2, F.col("series")))
        .unionByName(named(data, F.col("category_no") + 2, F.col("series_no") + 2, F.col("value")))
    )
    return cells.withColumn("cell", F.concat(spreadsheet_column(F.col("column")), F.col("row").cast("string")))


def series_references(data: DataFrame, chart: str) -> DataFrame:
    """chart, series_no and where its name, categories and values stand in the sheet."""
    rows = data.groupBy(chart).agg((F.max("category_no") + 2).cast("string").alias("last"))
    series = data.select(chart, "series_no").distinct().join(rows, chart)
    column = spreadsheet_column(F.col("series_no") + 2)
    at = lambda a, b: F.concat(F.lit(f"{SHEET}!$"), a, F.lit("$"), b)
    return series.select(
        chart,
        "series_no",
        at(column, F.lit("1")).alias("name_ref"),
        F.concat(at(F.lit("A"), F.lit("2")), F.lit(":$A$"), F.col("last")).alias("category_ref"),
        F.concat(at(column, F.lit("2")), F.lit(":$"), column, F.lit("$"), F.col("last")).alias("value_ref"),
    )


def refused_charts(sources: DataFrame, data: DataFrame, chart: str) -> DataFrame:
    """chart, source_series, new_series and INVALID_CHART where a chart's series and their replacements differ in number: all or nothing."""
    new = data.select(chart, "series_no").distinct().groupBy(chart).agg(F.count(F.lit(1)).alias("new_series"))
    both = sources.join(new, chart).filter(F.col("source_series") != F.col("new_series"))
    return both.select(chart, "source_series", "new_series", F.lit("INVALID_CHART").alias("code"))


def default_type_patches(defaults: DataFrame, wanted: DataFrame, package: str) -> DataFrame:
    """What must change so that every wanted extension (package, extension in small letters, content_type) has its content type: ``replace`` of a default that says otherwise, ``insert`` where there is none."""
    present = defaults.select(package, F.lower("extension").alias("extension"), F.col("content_type").alias("present"))
    both = wanted.join(present, [package, "extension"], "left")
    action = F.when(F.col("present").isNull(), "insert").when(F.col("present") != F.col("content_type"), "replace")
    return both.withColumn("action", action).filter("action is not null").select(package, "extension", "content_type", "action")
