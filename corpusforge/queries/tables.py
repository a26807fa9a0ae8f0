"""Tabular cards and row batches over line items read as text cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import sketches, tabular
from corpusforge.plans.projections import Tables
from corpusforge.queries.registry import query
from corpusforge.sources import files

NUMBERS = ["l_quantity", "l_extendedprice", "l_tax"]
CLASSES = ["l_returnflag", "l_linestatus", "l_linenumber"]
ROWS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _stats_sql(c: str, i: int) -> str:
    return f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS n, count({c}) AS valid, round(min({c}), 2) AS min, round(max({c}), 2) AS max, round(avg({c}), 2) AS mean, round(sum({c}), 0) AS sum, true AS numeric FROM lineitem"


@query(" UNION ALL ".join(_stats_sql(c, i) for i, c in enumerate(NUMBERS)))
def table_card_numeric(t: Tables):
    """Statistics of numeric columns, in one pass over the table."""
    return tabular.column_stats(t.read("lineitem"), NUMBERS).withColumn("sum", F.round("sum", 0))


def _top_sql(c: str, i: int) -> str:
    return f"SELECT {i} AS position, '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM lineitem) AS \"distinct\", {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS r FROM lineitem GROUP BY {c} QUALIFY r <= 8"


@query(" UNION ALL ".join(f"({_top_sql(c, i)})" for i, c in enumerate(CLASSES)))
def table_card_categorical(t: Tables):
    """The most frequent values of each column."""
    return tabular.top_values(t.read("lineitem"), CLASSES)


def monthly(t: Tables, columns: list[str]):
    """Sketches of columns by month of shipping, merged into those of all months."""
    rows = t.read("lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return sketches.merge(sketches.sketch(rows, columns, ["month"]))


@query(" UNION ALL ".join(f"(SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS r FROM lineitem GROUP BY {c} QUALIFY r <= 8)" for c in CLASSES))
def sketched_values(t: Tables):
    """The most frequent values of columns from sketches by month: exact, as there are few."""
    return sketches.frequent(monthly(t, CLASSES))


@query()
def sketched_columns(t: Tables):
    """Rows, distinct values and quantiles of wide columns from sketches by month; within bounds that tests hold."""
    found = sketches.figures(monthly(t, ["l_orderkey", "l_partkey", "l_extendedprice"]))
    return found.select("column", "rows", "cells", "numbers", "distinct", F.col("quantiles")[1].alias("median"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders ORDER BY o_orderkey LIMIT 750),
b AS (SELECT (rn - 1) // 15 AS b, rn, 'o_orderkey: ' || o_orderkey || '; o_orderstatus: ' || o_orderstatus || '; o_orderpriority: ' || o_orderpriority AS line FROM o)
SELECT (b + 1)::BIGINT AS chunk_index, 'orders — righe ' || min(rn) || '–' || max(rn) AS heading, string_agg(line, chr(10) ORDER BY rn) AS text FROM b GROUP BY b""")
def table_row_batches(t: Tables):
    """Verbalised rows, fifteen a chunk; the operator's own cap is fifty chunks."""
    return tabular.row_batches(t.read("orders"), "o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"], label="orders")


@query()
def table_chunks(t: Tables):
    """The card, the batches and the note of coverage of a whole table."""
    return tabular.table_chunks(t.read("orders"), "o_orderkey", ROWS, "orders")


@query("SELECT route, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'email' WHEN 2 THEN 'text' ELSE 'unsupported' END AS route FROM documents) GROUP BY route")
def format_routes(t: Tables):
    """Names by the way their files are read."""
    return t.read("documents").select(files.route(file_name()).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def file_name():
    return F.concat(F.lit("a/b.c/file.v"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".PDF"), F.lit(".eml"), F.lit(".txt"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int")))


@query()
def supported_formats(t: Tables):
    """Every supported extension, its route, and how many of the documents' files have it."""
    held = t.read("documents").select(files.extension(file_name()).alias("extension")).groupBy("extension").agg(F.count("*").alias("n"))
    return files.formats(t.spark).join(held, "extension", "left").select("extension", "route", F.coalesce("n", F.lit(0)).alias("n"))
