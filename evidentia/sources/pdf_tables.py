"""The text form of PDF pages and tables. Reading a PDF is a provider's work; its cells and texts come as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_PAGES = 32  # pages up to which a document's tables are read


def cell_text(c: Column) -> Column:
    """A cell in one line, with its bars escaped."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))


def coordinate(c: Column) -> Column:
    """A number with six decimals at most, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", c.cast("double")), r"\.?0+$", "")


def geometry(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, geometry: a table's box and the least left and greatest right edge of each column; none where one is missing.

    `cells`: keys, row, col, x1, x2, bbox (array of four)."""
    columns = cells.groupBy(*keys, "col").agg(F.min("x1").alias("l"), F.max("x2").alias("r"), F.count_if(F.col("x1").isNull() | F.col("x2").isNull()).alias("gaps"), F.first("bbox", True).alias("bbox"))
    listed = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", "l", "r"))).alias("c"), F.sum("gaps").alias("gaps"), F.first("bbox", True).alias("bbox"))
    edges = F.array_join(F.transform("c", lambda x: F.concat(coordinate(x["l"]), F.lit(":"), coordinate(x["r"]))), ";")
    box = F.array_join(F.transform("bbox", coordinate), ",")
    line = F.when((F.col("gaps") == 0) & (F.size("bbox") == 4), F.concat(F.lit("[GEOMETRY bbox="), box, F.lit(" columns="), edges, F.lit("]")))
    return listed.select(*keys, line.alias("geometry"))


def tables(cells: DataFrame) -> DataFrame:
    """path, page, table, block of each table; tables are numbered anew on each page.

    `cells`: path, page, table_ord, row, col (from 1), text, x1, x2, bbox."""
    keys = ["path", "page", "table_ord"]
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    rows = rows.withColumn("line", F.concat(F.lit("row="), F.col("row").cast("string"), F.lit(" | "), F.array_join(F.transform("c", lambda x: F.concat(F.lit("col="), x["col"].cast("string"), F.lit(": "), cell_text(x["text"]))), " | ")))
    body = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    numbered = body.withColumn("table", F.row_number().over(Window.partitionBy("path", "page").orderBy("table_ord"))).join(geometry(cells, keys), keys, "left")
    head = F.concat(F.lit("[TABLE page="), F.col("page").cast("string"), F.lit(" table="), F.col("table").cast("string"), F.lit("]"))
    return numbered.select("path", "page", "table", F.concat_ws("\n", head, "geometry", "body", F.lit("[/TABLE]")).alias("block"))


def documents(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """path, text: page texts, then tables, of documents (path, page, text; path, page, ... of cells).

    Tables are left out of documents of more than MOST_PAGES pages."""
    shown = F.concat(F.lit("[PAGE page="), F.col("page").cast("string"), F.lit("]\n"), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n[/PAGE]"))
    in_order = lambda *by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "block"))), lambda x: x["block"]), "\n\n")
    texts = pages.withColumn("block", shown).groupBy("path").agg(in_order("page").alias("texts"), F.count("*").alias("n"))
    made = tables(cells).groupBy("path").agg(in_order("page", "table").alias("tables"))
    joined = texts.join(made, "path", "left")
    return joined.select("path", F.concat_ws("\n\n", "texts", F.when(F.col("n") <= MOST_PAGES, F.col("tables"))).alias("text"))
