"""Mergeable sketches of columns too wide to group exactly: counts, distinct and frequent values, quantiles.

A row of sketches stands for one column of one part of a table (a day, a file). Rows merge
into those of longer times or of the whole table without reading it again, and the merged
figures keep the bounds of one pass:

- distinct values (HyperLogLog of 2^12 registers): within ``DISTINCT_ERROR`` of the count,
  three standard errors; exact to about two hundred values;
- frequent values (frequent items, ``TRACKED`` of them): a count is off by at most
  ``frequency_error`` of all values; exact while there are fewer than three quarters of
  ``TRACKED`` different ones; a value more frequent than the bound is always listed;
- quantiles of numbers (KLL): rank off by at most ``RANK_ERROR`` of all, at 99 per cent.

Blank cells and nulls are counted as rows and nothing else; text cells are stripped and
count as numbers where they can be read as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text

LG_REGISTERS, TRACKED = 12, 10_000
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2)
RANK_ERROR = 0.0165


def frequency_error(n: int, tracked: int = TRACKED) -> float:
    """How far a frequent value's count may be off among n values."""
    slots = 1 << max(3, (tracked - 1).bit_length())
    return 3.5 * n / slots


def sketch(df: DataFrame, columns: list[str], by: list[str] | None = None, tracked: int = TRACKED, decimal: str = ".") -> DataFrame:
    """(by..., column, rows, cells, numbers, distinct_sketch, top_sketch, number_sketch), one pass over the table."""
    by = by or []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text.strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("cell")) for c in columns])
    long = df.select(*by, F.explode(cells).alias("x")).select(*by, "x.column", F.when(F.col("x.cell") != "", F.col("x.cell")).alias("cell"))
    long = long.withColumn("number", text.parse_number(F.coalesce("cell", F.lit("")), decimal))
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("cell").alias("cells"),
        F.count("number").alias("numbers"),
        F.hll_sketch_agg("cell", LG_REGISTERS).alias("distinct_sketch"),
        F.expr(f"approx_top_k_accumulate(cell, {tracked})").alias("top_sketch"),
        F.kll_sketch_agg_double("number").alias("number_sketch"),
    )


def merge(sketches: DataFrame, by: list[str] | None = None, tracked: int = TRACKED) -> DataFrame:
    """Sketches of coarser parts: one row for each of ``by`` and column."""
    return sketches.groupBy(*(by or []), "column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "cells", "numbers")],
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.expr(f"approx_top_k_combine(top_sketch, {tracked})").alias("top_sketch"),
        F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
    )


def figures(sketches: DataFrame, by: list[str] | None = None, quantiles: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """(by..., column, rows, cells, numbers, distinct, quantiles) of each row of sketches."""
    some = F.col("numbers") > 0
    at = F.array(*[F.lit(q) for q in quantiles])
    return sketches.select(*(by or []), "column", "rows", "cells", "numbers", F.hll_sketch_estimate("distinct_sketch").alias("distinct"), F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col("number_sketch")), at)).alias("quantiles"))


def frequent(sketches: DataFrame, by: list[str] | None = None, top: int = 8, tracked: int = TRACKED) -> DataFrame:
    """(by..., column, value, n, r): the most frequent values of each row of sketches, of equal counts the least first."""
    by = by or []
    # the sketch's own order of equal counts isn't by value, so all that it tracks are ordered
    listed = sketches.select(*by, "column", F.explode(F.expr(f"approx_top_k_estimate(top_sketch, {tracked})")).alias("x")).select(*by, "column", F.col("x.item").alias("value"), F.col("x.count").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*by, "column").orderBy(F.desc("n"), "value")).cast("long")
    return listed.filter(F.col("value").isNotNull()).withColumn("r", nth).filter(F.col("r") <= top)
