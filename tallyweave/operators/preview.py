"""Previews of files and the header rows of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that are looked at, cells, and shares of filled, text and different cells.
AMONG, LEAST, FILLED, TEXT, DIFFERENT = 15, 2, 0.5, 0.8, 0.8
NUMBER = r"^-?[\d.,]+$"


def looks_like_header(cells: Column) -> Column:
    """Two filled cells and more, half of all cells; four fifths of these text, and different."""
    full = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    n = F.size(full)
    words = F.size(F.filter(full, lambda c: ~c.rlike(NUMBER)))
    return (n >= LEAST) & (n >= FILLED * F.size(cells)) & (words >= TEXT * n) & (F.size(F.array_distinct(full)) >= DIFFERENT * n)


def header_rows(rows: DataFrame) -> DataFrame:
    """(sheet, header): the first row of each sheet that looks like a header, null if none of its first
    rows does. rows: sheet, k (from 0), cells."""
    fits = F.when((F.col("k") < AMONG) & looks_like_header(F.col("cells")), F.col("k"))
    return rows.groupBy("sheet").agg(F.min(fits).alias("header"))


def previews(files: DataFrame, rows: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A row for each file: kind ('table', 'text' or 'empty', by the file's first row), headers (columns of that
    row), total, and the page of the rows: cells as text, missing ones empty, or blocks of text. files: path; rows:
    path, row_number, columns, data, text. Only the rows of the page are gathered; they are cut before."""
    first = F.min(F.struct("row_number", F.struct(F.size("columns").alias("n"), "columns").alias("c"))).alias("f")
    sums = rows.groupBy("path").agg(F.count("*").alias("total"), first)
    place = F.row_number().over(Window.partitionBy("path").orderBy("row_number"))
    page = rows.withColumn("_k", place).where(F.col("_k") <= limit + max(0, offset)).where(F.col("_k") > max(0, offset))
    page = page.join(sums.select("path", F.col("f.c.columns").alias("headers")), "path")
    cells = F.transform("headers", lambda h: F.coalesce(F.try_element_at("data", h), F.lit("")))
    shown = F.when(F.size("headers") > 0, cells).otherwise(F.array(F.coalesce("text", F.lit(""))))
    blocks = page.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_k", shown.alias("cells")))).alias("b"))
    out = files.select("path").distinct().join(sums, "path", "left").join(blocks, "path", "left")
    kind = F.when(F.col("total").isNull(), "empty").when(F.col("f.c.n") > 0, "table").otherwise("text")
    return out.select("path", kind.alias("kind"), F.coalesce("f.c.columns", F.array().cast("array<string>")).alias("headers"), F.coalesce("total", F.lit(0)).alias("total"), F.transform("b", lambda x: x["cells"]).alias("rows"))
