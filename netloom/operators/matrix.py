"""Tagged matrices in long form: ``row_tag, col_tag, v``; a cell that has no row is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_rows(rows: DataFrame, columns: list[str] | None = None, first: int = 1) -> DataFrame:
    """The matrix of ``row_tag, x array<double>``; column tags are ``columns`` or numbers from ``first``."""
    cell = rows.select("row_tag", F.posexplode("x").alias("j", "v"))
    if columns is None:
        return cell.select("row_tag", (F.col("j") + first).cast("string").alias("col_tag"), "v")
    tags = F.array(*[F.lit(c) for c in columns])
    return cell.select("row_tag", F.get(tags, F.col("j")).alias("col_tag"), "v")


def size(cells: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_cols, n_cells``, of tags that occur."""
    return cells.agg(F.countDistinct("row_tag").alias("n_rows"), F.countDistinct("col_tag").alias("n_cols"), F.count("*").alias("n_cells"))


def subset(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """``at, row_tag, col_tag, v``: the rows that ``wanted`` (``at, row_tag``) lists, as often as it lists them."""
    return wanted.select("at", "row_tag").join(cells, "row_tag").select("at", "row_tag", "col_tag", "v")


def project(cells: DataFrame, rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Every cell of the row tags ``rows`` (``row_tag``) and column tags ``columns`` (``col_tag``, all if not given); missing cells are 0.

    The result is the grid that was asked for: rows times columns.
    """
    over = cells.select("col_tag").distinct() if columns is None else columns.select("col_tag").distinct()
    grid = rows.select("row_tag").distinct().crossJoin(over)
    return grid.join(cells, ["row_tag", "col_tag"], "left").select("row_tag", "col_tag", F.coalesce("v", F.lit(0.0)).alias("v"))


def put(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Set cells: those of ``changes`` replace or join the others; their rows and columns come into being."""
    return cells.join(changes, ["row_tag", "col_tag"], "left_anti").select("row_tag", "col_tag", "v").union(changes.select("row_tag", "col_tag", "v"))


def remove(cells: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Take out whole rows (``row_tag``) and columns (``col_tag``)."""
    if rows is not None:
        cells = cells.join(rows.select("row_tag"), "row_tag", "left_anti")
    if columns is not None:
        cells = cells.join(columns.select("col_tag"), "col_tag", "left_anti")
    return cells.select("row_tag", "col_tag", "v")


def remove_cells(cells: DataFrame, gone: DataFrame) -> DataFrame:
    """Take out single cells (``row_tag, col_tag``)."""
    return cells.join(gone.select("row_tag", "col_tag"), ["row_tag", "col_tag"], "left_anti").select("row_tag", "col_tag", "v")
