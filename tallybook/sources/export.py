"""Reports as text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallybook.functions.text import clip_text, null_label
from tallybook.operators.scopes import shared_folder
from tallybook.sources.store import remove

# Fixed value: the widest column of a screen.
SCREEN_WIDTH = 45
#: The column that keeps the order of stored rows.
_PLACE = "place in the report"


def _shown(column: str):
    return null_label(F.col(column).cast("string"))


def _width(column: str, shown: Column, limit: int | None) -> Column:
    """The longest text of a column, header included, up to the limit if there is one."""
    width = F.greatest(F.coalesce(F.max(F.length(shown)), F.lit(0)), F.lit(len(column)))
    return (width if limit is None else F.least(width, F.lit(limit))).alias(column)


def column_widths(report: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: per column the longest text, header included, up to the limit if there is one."""
    return report.agg(*[_width(c, _shown(c), limit) for c in report.columns])


def _stored_with_widths(report: DataFrame, limit: int | None) -> tuple[DataFrame, dict[str, int], str]:
    """The report's cells as texts in their order, the widths of its columns, and the folder the cells are in.

    The report is computed once: its widths are observed while its rows are written.
    """
    spark = report.sparkSession
    folder = f"{shared_folder(spark)}/tallybook/export-{uuid.uuid4().hex}"
    widths = Observation()
    cells = report.select(*[_shown(c).alias(c) for c in report.columns])
    placed = cells.observe(widths, *[_width(c, F.col(c), limit) for c in report.columns]).withColumn(
        _PLACE, F.monotonically_increasing_id()
    )
    placed.write.parquet(folder)
    return spark.read.schema(placed.schema).parquet(folder).orderBy(_PLACE).drop(_PLACE), widths.get, folder


def _lines(cells: DataFrame, widths: dict[str, int], gap: str) -> DataFrame:
    padded = [F.rpad(clip_text(F.col(c), widths[c]), widths[c], " ") for c in cells.columns]
    return cells.select(F.concat_ws(gap, *padded).alias("line"))


def text_lines(report: DataFrame, gap: str = " | ", limit: int | None = None) -> DataFrame:
    """One ``line`` per report row: cells padded to their column's width, and clipped to the limit."""
    widths = column_widths(report, limit).first().asDict()
    return _lines(report.select(*[_shown(c).alias(c) for c in report.columns]), widths, gap)


def header_line(report: DataFrame, gap: str = " | ", limit: int | None = None) -> str:
    """The column names, laid out like the lines below them."""
    widths = column_widths(report, limit).first().asDict()
    return gap.join(_clip(c, widths[c]).ljust(widths[c]) for c in report.columns)


def _clip(text: str, size: int) -> str:
    return text if len(text) <= size else text[: size - 3] + "..."


def export_report(report: DataFrame, path: str, form: str = "csv", limit: int | None = None) -> None:
    """Write a report as CSV with a header, or as aligned text lines; ``limit`` clips the cells of the latter.

    Rows keep the report's order over the numbered part files. The report is computed once, for lines of
    text as well: their cells are written to the shared folder while widths are observed.
    """
    if form == "csv":
        shown = report.select(*[_shown(c).alias(c) for c in report.columns])
        shown.write.option("header", True).csv(path)
    elif form == "text":
        cells, widths, folder = _stored_with_widths(report, limit)
        _lines(cells, widths, " | ").write.text(path)
        remove(report.sparkSession, folder)
    else:
        raise ValueError(f"form must be csv or text, not {form}")
