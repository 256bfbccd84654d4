"""Workbooks in SpreadsheetML: every task writes a workbook of its rows, in sheets of a bounded number of rows, and a summary has one of its own.

The files go through Spark's text sink, so they are committed like any other table and stand in any store. A row is one
line: breaks and tabs inside a cell are written as references, so a reader takes lines and never a whole file. NULL is an
empty cell and an empty text a cell with nothing in it; characters that XML has no place for are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a sheet; older programs open no more than 65,536.
SHEET_ROWS = 65_000
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">'
_MARKS = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;"))


def escaped(c: Column) -> Column:
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for char, mark in _MARKS:
        out = F.replace(out, F.lit(char), F.lit(mark))
    return out


def unescaped(c: Column) -> Column:
    for char, mark in reversed(_MARKS):
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def _cell(c: Column, kind: T.DataType) -> Column:
    sort = "Number" if isinstance(kind, T.NumericType) else "Boolean" if isinstance(kind, T.BooleanType) else "DateTime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "String"
    text = c.cast("int").cast("string") if sort == "Boolean" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if sort == "DateTime" else c.cast("string")
    return F.coalesce(F.concat(F.lit(f'<Cell><Data ss:Type="{sort}">'), escaped(text), F.lit("</Data></Cell>")), F.lit("<Cell/>"))


def row_lines(df: DataFrame) -> DataFrame:
    """One column, a line for each row."""
    return df.select(F.concat(F.lit("<Row>"), *(_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit("</Row>")).alias("value"))


def write_workbooks(df: DataFrame, path: str, sheet: str = "Rows", rows: int = SHEET_ROWS) -> None:
    """A workbook for each partition, none for empty ones."""
    head = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(df.columns))]))
    titles = row_lines(head).first()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for f in frames:
            out = []
            for line in f["value"]:
                if n % rows == 0:
                    out += ["</Table></Worksheet>"] if n else [_HEAD]
                    out += [f'<Worksheet ss:Name="{sheet} {n // rows + 1}"><Table>', titles]
                n += 1
                out.append(line)
            yield pd.DataFrame({"value": out})
        if n:
            yield pd.DataFrame({"value": ["</Table></Worksheet></Workbook>"]})

    row_lines(df).mapInPandas(run, "value string").write.text(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """A workbook with the rows of a summary, which are few, in one sheet."""
    write_workbooks(rows.coalesce(1), path, "Summary")


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """cells of every row of workbooks that have a row to a line, the rows of titles among them; a cell is NULL where it is empty."""
    lines = spark.read.text(path).where(F.col("value").startswith("<Row"))
    cells = F.regexp_extract_all("value", F.lit(r"<Cell[^>]*?(?:/>|>.*?</Cell>)"), F.lit(0))
    return lines.select(F.transform(cells, lambda c: F.when(~c.endswith("/>"), unescaped(F.regexp_extract(c, r"<Data[^>]*>(.*?)</Data>", 1)))).alias("cells"))


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What write_workbooks() has written, as columns of a schema."""
    shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    titles = F.array(*(F.lit(n) for n in shape.names))
    rows = sheet_cells(spark, path).where(~F.coalesce(F.col("cells") == titles, F.lit(False)))
    return rows.select(*(F.get("cells", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(shape)))
