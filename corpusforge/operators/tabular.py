"""Tables of text cells: column statistics, cards and verbalised row batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions import text

NUMERIC_SHARE, TOP_VALUES, ROWS_PER_CHUNK, MAX_CHUNKS, SAMPLE_ROWS = 0.8, 8, 15, 50, 5


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, column, value): one pass over the table for all columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), text.strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("x")).select("x.*")


def column_stats(df: DataFrame, columns: list[str] | None = None, decimal: str = ".", digits: int = 2) -> DataFrame:
    """Per column: rows, numbers among them, whether it is numeric, and their min, max, mean and sum."""
    kinds = dict(df.dtypes)
    columns = columns or df.columns

    def stats(i: int, c: str):
        number = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        x = F.col(f"`{c}`").cast("double") if number else text.parse_number(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), decimal)
        each = {"n": F.count(F.lit(1)), "valid": F.count(x)} | {k: F.round(f(x), digits) for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sum", F.sum))}
        return F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), *[v.alias(k) for k, v in each.items()])

    out = df.agg(F.array(*[stats(i, c) for i, c in enumerate(columns)]).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return out.withColumn("numeric", (F.col("n") > 0) & (F.col("valid") >= F.greatest(F.lit(1), F.floor(NUMERIC_SHARE * F.col("n")))))


def top_values(df: DataFrame, columns: list[str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """(position, column, distinct, value, n, r): the most frequent values of each column."""
    counts = _long(df, columns or df.columns).filter("value <> ''").groupBy("position", "column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("column")
    best = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "value")).cast("long"))
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    return best.filter(F.col("r") <= top).join(F.broadcast(distinct), "column").select("position", "column", "distinct", "value", "n", "r")  # a row a column


def card_lines(df: DataFrame, columns: list[str] | None = None, decimal: str = ".") -> DataFrame:
    """(position, line): one line of statistics for each column of the card."""
    stats = column_stats(df, columns, decimal, digits=6)
    tops = top_values(df, columns).groupBy("position").agg(
        F.max("distinct").alias("distinct"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda s: F.concat(text.clip(s["value"], 48), F.lit(" ("), s["n"].cast("string"), F.lit(")"))), "; ").alias("top"),
    )
    num = F.concat(F.lit(" (num): min="), text.italian_number("min"), F.lit(", max="), text.italian_number("max"), F.lit(", media="), text.italian_number("mean"), F.lit(", somma="), text.italian_number("sum"), F.lit(", valorizzati="), F.col("valid").cast("string"), F.lit("/"), F.col("n").cast("string"))
    cat = F.concat(F.lit(" (cat): "), F.coalesce("distinct", F.lit(0)).cast("string"), F.lit(" valori distinti — frequenti: "), F.coalesce("top", F.lit("")))
    return stats.join(tops, "position", "left").select("position", F.concat(F.lit("- "), F.col("column"), F.when(F.col("numeric"), num).otherwise(cat)).alias("line"))


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """Row numbers from 1 by a number, over buckets of its ranges and sums of their sizes."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.select(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"] or [])) if n > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(order))) if bounds else F.lit(0)
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_c"))  # a row a bucket
    before = sizes.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return rows.join(F.broadcast(before), "_b").withColumn(name, nth + F.col("_before")).drop("_b", "_before")


def row_batches(df: DataFrame, order: str, columns: list[str], rows_per_chunk: int = ROWS_PER_CHUNK, max_chunks: int = MAX_CHUNKS, label: str = "table") -> DataFrame:
    """(chunk_index, heading, text): verbalised rows in batches, the first ``max_chunks``.

    The cap is the operator's own; ``order``, a number, ranks rows. Below zero it
    takes all rows, which are numbered by bucket.
    """
    rows = df.select(F.col(order).alias("_o"), text.verbalize(columns).alias("line"))
    if max_chunks >= 0:
        rows = rows.orderBy("_o").limit(max_chunks * rows_per_chunk)  # at most that many in the window
        numbered = rows.withColumn("rn", F.row_number().over(Window.orderBy("_o")))
    else:
        numbered = number_rows(rows, "_o", "rn")
    batch = numbered.withColumn("b", F.floor((F.col("rn") - 1) / rows_per_chunk).cast("long"))
    out = batch.groupBy("b").agg(
        F.min("rn").alias("first"),
        F.max("rn").alias("last"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda s: s["line"] != ""), lambda s: s["line"]), "\n").alias("text"),
    ).filter("text <> ''")
    heading = F.format_string("%s — righe %d–%d", F.lit(label), F.col("first"), F.col("last"))
    return out.select((F.col("b") + 1).alias("chunk_index"), heading.alias("heading"), "text")


def table_chunks(df: DataFrame, order: str, columns: list[str], label: str, decimal: str = ".", rows_per_chunk: int = ROWS_PER_CHUNK, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(chunk_index, heading, text): the card, the row batches, and a note of coverage where they are cut."""
    n = df.count()
    sample = df.orderBy(order).limit(SAMPLE_ROWS).select(F.col(order).alias("o"), text.verbalize(columns).alias("line"))
    lines = card_lines(df, columns, decimal).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda s: s["line"]).alias("lines"))
    shown = sample.agg(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda s: s["line"] != ""), lambda s: F.concat(F.lit("• "), s["line"])).alias("shown"))
    head = [f"Tabella «{label}» — {n} righe × {len(columns)} colonne.", "Colonne: " + ", ".join(columns) + ".", "", "Statistiche per colonna:"]
    stats = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array(F.lit("- (tabella senza righe)")))
    tail = F.concat(F.array(F.lit(""), F.lit(f"Righe campione (prime {min(SAMPLE_ROWS, n)}):")), F.col("shown")) if n else F.array().cast("array<string>")
    card = lines.join(shown).select(F.lit(0).cast("long").alias("chunk_index"), F.lit(f"Riepilogo tabella: {label}").alias("heading"), F.array_join(F.concat(F.array(*[F.lit(h) for h in head]), stats, tail), "\n").alias("text"))  # one row each
    out = card
    if rows_per_chunk > 0 and max_chunks != 0 and n:
        out = out.unionByName(row_batches(df, order, columns, rows_per_chunk, max_chunks, label))
    emitted = n if max_chunks < 0 else min(n, max_chunks * max(rows_per_chunk, 0))
    if emitted < n:
        note = f"Copertura indice: della tabella «{label}» sono indicizzate come righe {emitted} di {n}; la table card riassume l'intera tabella."
        out = out.unionByName(card.select(F.lit(max(max_chunks, 0) + 1).cast("long").alias("chunk_index"), F.lit(f"{label} — copertura indice").alias("heading"), F.lit(note).alias("text")))
    return out
